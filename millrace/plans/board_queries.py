"""Queries on boards: scores, evaluation, symmetry, duplicates, gains, closure, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import bitboard as B
from millrace.operators.corpus import PHASES, SOURCE_PHASES, deduplicate, phase_of, representative_upgrades, splits_by_component
from millrace.plans.adapters import POSITIONS_DUCK, positions

_EVALUATED = "CASE WHEN ply % 2 = 0 THEN 1 ELSE -1 END * ((s1 - (ply + 1) // 2 + 25) * 2 - ((s2 - ply // 2 + 24) * 2 + 11))"


def _lines_values() -> str:
    return ", ".join(f"({k}, {j}, {c}, {len(line)})" for k, line in enumerate(B.scoring_lines()) for j, c in enumerate(line))


def duck_scores(source: str, boards: tuple[str, ...] = ("p1", "p2")) -> str:
    """Scores by finding the maximal runs of pieces along every line: (b, s) for each distinct board of a relation."""
    union = " UNION ".join(f"SELECT {b} AS b FROM {source}" for b in boards)
    return f"""
SELECT u.b, CAST(coalesce(r.runs, 0) + bit_count(u.b) - coalesce(r.covered, 0) AS INT) AS s FROM ({union}) u LEFT JOIN (
  SELECT b, sum(part) AS runs, bit_count(bit_or(cells)) AS covered FROM (
    SELECT b, line, g, CAST(power(2, count(*) - 1) AS BIGINT) AS part, bit_or(CAST(1 AS BIGINT) << cell) AS cells FROM (
      SELECT b, line, cell, pos - row_number() OVER (PARTITION BY b, line ORDER BY pos) AS g
      FROM ({union}) x JOIN (VALUES {_lines_values()}) l(line, pos, cell, size) ON (b >> cell) & 1 = 1) GROUP BY b, line, g HAVING count(*) >= 2) GROUP BY b) r ON u.b = r.b"""


_SCORED = f"""
WITH p AS ({POSITIONS_DUCK}), sc AS ({duck_scores("p")}),
 e AS (SELECT p.*, a.s AS s1, c.s AS s2 FROM p JOIN sc a ON p.p1 = a.b JOIN sc c ON p.p2 = c.b)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_scores(positions(spark, sf_dir), s1="p1", s2="p2")


def position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    return df.select("trajectory", "ply", "p1", "p2", "s1", "s2", B.static_evaluation(F.col("s1"), F.col("s2"), F.col("ply")).alias("evaluation"), B.winner(F.col("s1"), F.col("s2")).alias("winner"), (B.CELLS - F.bit_count(F.col("p1").bitwiseOR(F.col("p2")))).cast("int").alias("empties"), B.format_move(F.col("cell")).alias("move"))


_POSITION_SCORES = _SCORED + f"""
SELECT trajectory, ply, p1, p2, s1, s2, CAST({_EVALUATED} AS INT) AS evaluation, CASE WHEN 2 * s1 > 2 * s2 + 11 THEN 'p1' ELSE 'p2' END AS winner,
  CAST(49 - ply AS INT) AS empties, chr(CAST(97 + cell % 7 AS INT)) || CAST(cell // 7 + 1 AS VARCHAR) AS move FROM e"""


def eval_metrics_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the static evaluation against the margin at the trajectory's end, overall and by phase."""
    df = scored(spark, sf_dir)
    last = F.struct(F.col("ply").alias("k"), (2 * F.col("s1") - 2 * F.col("s2") - 11).alias("m"))
    final = df.groupBy("trajectory").agg(F.max(last).alias("f"))
    margin = F.when(F.col("side") == 0, F.col("f.m")).otherwise(-F.col("f.m"))
    error = df.join(final, "trajectory").select(phase_of(F.col("ply"), PHASES).alias("phase"), (B.static_evaluation(F.col("s1"), F.col("s2"), F.col("ply")) - margin).alias("e"), F.signum(margin.cast("double")).alias("want"), F.signum(B.static_evaluation(F.col("s1"), F.col("s2"), F.col("ply")).cast("double")).alias("got"))
    measures = [F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.avg("e"), 6).alias("mean_error"), F.max(F.abs("e")).alias("max_error"), F.round(F.avg((F.col("want") == F.col("got")).cast("double")), 6).alias("sign_accuracy")]
    return error.groupingSets([[], [F.col("phase")]], F.col("phase")).agg(*measures).select(F.coalesce("phase", F.lit("overall")).alias("stratum"), "n", "mae", "rmse", "mean_error", "max_error", "sign_accuracy")


def _phase_case(phases: list[tuple[int, int]]) -> str:
    return "CASE " + " ".join(f"WHEN ply BETWEEN {a} AND {b} THEN 'ply_{a:02d}_{b:02d}'" for a, b in phases) + " ELSE 'ply_' || lpad(CAST(ply AS VARCHAR), 2, '0') END"


_EVAL_METRICS = _SCORED + f""",
 f AS (SELECT trajectory, arg_max(2 * s1 - 2 * s2 - 11, ply) AS m FROM e GROUP BY 1),
 x AS (SELECT {_phase_case(PHASES)} AS phase, {_EVALUATED} AS v, CASE WHEN ply % 2 = 0 THEN m ELSE -m END AS t FROM e JOIN f USING (trajectory)),
 y AS (SELECT phase, v - t AS d, CAST(sign(v) = sign(t) AS DOUBLE) AS ok FROM x UNION ALL SELECT 'overall', v - t, CAST(sign(v) = sign(t) AS DOUBLE) FROM x)
SELECT phase AS stratum, count(*) AS n, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(CAST(d AS DOUBLE) * d)), 6) AS rmse, round(avg(d), 6) AS mean_error, max(abs(d)) AS max_error, round(avg(ok), 6) AS sign_accuracy FROM y GROUP BY 1"""


def canonical_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_canonical(positions(spark, sf_dir)).select("trajectory", "ply", "canonical_low", "canonical_high", "symmetry", "stabilizer")


def _canonical_sql() -> str:
    rows = ", ".join(f"({k}, {c}, {B.transform_cell(k, c)})" for k in range(8) for c in range(49))
    return f"""
p AS ({POSITIONS_DUCK}), t AS (SELECT * FROM (VALUES {rows}) v(k, cell_from, cell_to)),
 im AS (SELECT trajectory, p.ply, k, any_value(p.p1) AS p1, any_value(p.p2) AS p2, any_value(p.side) AS side,
   bit_or(CASE WHEN (p.p1 >> cell_from) & 1 = 1 THEN CAST(1 AS BIGINT) << cell_to ELSE 0 END) AS a,
   bit_or(CASE WHEN (p.p2 >> cell_from) & 1 = 1 THEN CAST(1 AS BIGINT) << cell_to ELSE 0 END) AS b FROM p, t GROUP BY trajectory, p.ply, k),
 rk AS (SELECT *, row_number() OVER (PARTITION BY trajectory, ply ORDER BY a, b, k) AS n, sum(CASE WHEN a = p1 AND b = p2 THEN 1 << k ELSE 0 END) OVER (PARTITION BY trajectory, ply) AS st FROM im),
 c AS (SELECT trajectory, ply, a AS canonical_low, b + side * (CAST(1 AS BIGINT) << 49) AS canonical_high, CAST(k AS INT) AS symmetry, CAST(st AS INT) AS stabilizer FROM rk WHERE n = 1)
"""


_CANONICAL = f"WITH {_canonical_sql()} SELECT * FROM c"


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with canonical keys and pseudo-labels, in arrival order (shard, ordinal)."""
    df = B.with_canonical(positions(spark, sf_dir))
    return df.select("canonical_low", "canonical_high", "trajectory", "ply", F.pmod("trajectory", F.lit(4)).alias("shard"), (F.col("trajectory") * 64 + F.col("ply")).alias("ordinal"), (1 + F.pmod(F.col("trajectory") + F.col("ply"), F.lit(6))).cast("int").alias("depth"), F.pmod(F.col("trajectory") * 7 + F.col("ply") * 3, F.lit(41)).cast("int").alias("value"))


_RECORDS = f"""{_canonical_sql()}, rec AS (SELECT canonical_low, canonical_high, trajectory, ply, trajectory % 4 AS shard, trajectory * 64 + ply AS ordinal, CAST(1 + (trajectory + ply) % 6 AS INT) AS depth, CAST((trajectory * 7 + ply * 3) % 41 AS INT) AS value FROM c)"""


def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of every canonical position: deepest, then first by trajectory and sample."""
    return deduplicate(corpus_records(spark, sf_dir), ["canonical_low", "canonical_high"], F.struct("depth", -F.col("trajectory"), -F.col("ply")), ["trajectory", "ply", "depth", "value"])


_DEDUP = f"""WITH {_RECORDS} SELECT canonical_low, canonical_high, trajectory, ply, depth, value, duplicate_count FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_low, canonical_high ORDER BY depth DESC, trajectory, ply) AS n, count(*) OVER (PARTITION BY canonical_low, canonical_high) AS duplicate_count FROM rec) WHERE n = 1"""


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups and records, largest group, groups with varying labels, and upgrades of the representative in arrival order."""
    df = corpus_records(spark, sf_dir)
    key = ["canonical_low", "canonical_high"]
    groups = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("value").alias("labels"))
    one = groups.agg(F.sum("n").alias("records"), F.count("*").alias("unique_positions"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_records"), F.max("n").alias("maximum_duplicate_count"), F.count_if(F.col("labels") > 1).alias("varying_label_groups"))
    ups = representative_upgrades(df, key, F.struct("depth", -F.col("trajectory"), -F.col("ply")), ["shard", "ordinal"])
    return one.crossJoin(ups)  # a row each


_DEDUP_SUMMARY = f"""WITH {_RECORDS}, g AS (SELECT count(*) AS n, count(DISTINCT value) AS labels FROM rec GROUP BY canonical_low, canonical_high),
 o AS (SELECT *, row_number() OVER (PARTITION BY canonical_low, canonical_high ORDER BY shard, ordinal) AS i FROM rec),
 u AS (SELECT count(*) AS n FROM o x WHERE i > 1 AND NOT EXISTS (SELECT 1 FROM o y WHERE y.canonical_low = x.canonical_low AND y.canonical_high = x.canonical_high AND y.i < x.i AND (y.depth, -y.trajectory, -y.ply) >= (x.depth, -x.trajectory, -x.ply)))
SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS unique_positions, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_records, max(n) AS maximum_duplicate_count, count(*) FILTER (WHERE labels > 1) AS varying_label_groups, (SELECT n FROM u) AS representative_upgrades FROM g"""


def trajectory_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories that share a canonical position, their component and its split, and the shard of a balanced contiguous range."""
    df = corpus_records(spark, sf_dir)
    parts = splits_by_component(df, ["canonical_low", "canonical_high"], "trajectory", seed=20260818)
    w = Window.orderBy("trajectory")  # a row a trajectory: the index of balanced ranges is global
    return parts.withColumn("index", F.row_number().over(w) - 1).join(parts.agg(F.count("*").alias("total")), how="cross").select("trajectory", "component", "split", F.expr("CAST(CASE WHEN index < (total % 4) * (total div 4 + 1) THEN index div (total div 4 + 1) ELSE (total % 4) + (index - (total % 4) * (total div 4 + 1)) div greatest(total div 4, 1) END AS INT)").alias("shard"))


_WRAP = "% 18446744073709551616::UHUGEINT"
_MIX1 = f"((xor(z, z >> 30))::UHUGEINT * 13787848793156543929::UHUGEINT) {_WRAP}"
_COMPONENTS = f"""WITH RECURSIVE {_RECORDS},
 firsts AS (SELECT canonical_low, canonical_high, min(trajectory) AS m FROM rec GROUP BY 1, 2),
 ed AS (SELECT DISTINCT trajectory AS a, m AS b FROM rec JOIN firsts USING (canonical_low, canonical_high)),
 sym AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
 reach AS (SELECT DISTINCT trajectory AS a, trajectory AS b FROM rec UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
 comp AS (SELECT a AS trajectory, min(b) AS component FROM reach GROUP BY 1),
 h0 AS (SELECT *, xor(xor(20260818::UHUGEINT, component::UHUGEINT), 10723151780598845931::UHUGEINT) AS z FROM comp),
 h1 AS (SELECT *, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) {_WRAP} AS y FROM h0),
 h2 AS (SELECT *, (xor(y, y >> 27) * 10723151780598845931::UHUGEINT) {_WRAP} AS x FROM h1),
 h3 AS (SELECT *, xor(x, x >> 31) % 100 AS bucket FROM h2),
 ix AS (SELECT *, row_number() OVER (ORDER BY trajectory) - 1 AS i, count(*) OVER () AS n FROM h3)
SELECT trajectory, component, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'test' END AS split,
  CAST((SELECT max(s) FROM range(4) r(s) WHERE s * (n // 4) + least(s, n % 4) <= i) AS INT) AS shard FROM ix"""


def group_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations: canonical groups that cross splits of their trajectories, and groups whose equal depths have several values."""
    df = corpus_records(spark, sf_dir).withColumn("split", F.pmod("trajectory", F.lit(3)))
    key = ["canonical_low", "canonical_high"]
    crossing = df.groupBy(*key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("crosses_splits").alias("rule"), *key)
    varying = df.groupBy(*key, "depth").agg(F.count_distinct("value").alias("n")).filter("n > 1").select(F.lit("varying_value").alias("rule"), *key).distinct()
    return crossing.unionByName(varying)


_INTEGRITY = f"""WITH {_RECORDS} SELECT 'crosses_splits' AS rule, canonical_low, canonical_high FROM rec GROUP BY 2, 3 HAVING count(DISTINCT trajectory % 3) > 1
UNION ALL SELECT DISTINCT 'varying_value', canonical_low, canonical_high FROM (SELECT canonical_low, canonical_high, depth FROM rec GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1)"""


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of both players at every empty cell of every position."""
    df = positions(spark, sf_dir)
    return B.with_gains(B.explode_empty(df, F.col("p1").bitwiseOR(F.col("p2")), "cell"))


GAINS = f"""p AS ({POSITIONS_DUCK}), q AS (SELECT trajectory, ply, side, p1, p2, CAST(k AS INT) AS cell, p1 | (CAST(1 AS BIGINT) << k) AS n1, p2 | (CAST(1 AS BIGINT) << k) AS n2 FROM p, range(49) r(k) WHERE ((p1 | p2) >> k) & 1 = 0),
 bb AS (SELECT p1 AS b FROM p UNION SELECT p2 FROM p UNION SELECT n1 FROM q UNION SELECT n2 FROM q), sc AS ({duck_scores("bb", ("b",))}),
 g AS (SELECT q.*, CASE WHEN side = 0 THEN c.s - a.s ELSE d.s - b.s END AS own_gain, CASE WHEN side = 0 THEN d.s - b.s ELSE c.s - a.s END AS opponent_gain, a.s AS s1, b.s AS s2 FROM q JOIN sc a ON p1 = a.b JOIN sc b ON p2 = b.b JOIN sc c ON n1 = c.b JOIN sc d ON n2 = d.b)
"""
_GAINS = f"WITH {GAINS}"


def move_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains(spark, sf_dir).select("trajectory", "ply", "cell", "own_gain", "opponent_gain")


_MOVE_GAINS = _GAINS + "SELECT trajectory, ply, cell, own_gain, opponent_gain FROM g"


def _row_arrays(df: DataFrame, key: list[str]) -> DataFrame:
    """A row a position: its empty cells' gains, with both best replies."""
    by = Window.partitionBy(*key)
    ranked = df.withColumn("rank", F.row_number().over(by.orderBy(F.desc("opponent_gain"), "cell")))
    first, second = F.max(F.when(F.col("rank") == 1, F.col("opponent_gain"))).over(by), F.max(F.when(F.col("rank") == 2, F.col("opponent_gain"))).over(by)
    reply = F.when((F.col("rank") == 1), second).otherwise(first)
    return ranked.withColumns({"reply": reply, "best_reply": first, "empties": F.count("*").over(by)})


def closure_of(gained: DataFrame, boards: DataFrame, key: list[str]) -> DataFrame:
    """Static evaluation after the best move and the best reply elsewhere; with one empty cell, after that move alone, on a full board, as it is.

    ``gained`` has both gains of every empty cell, ``boards`` scores and ply of every position.
    """
    best = _row_arrays(gained, key).groupBy(*key).agg(F.max(F.col("own_gain") - F.col("reply")).alias("best"), F.max("own_gain").alias("only"), F.first("empties").alias("empties"))
    base = boards.withColumn("base", B.static_evaluation(F.col("s1"), F.col("s2"), F.col("ply")))
    more = F.when(F.col("empties") >= 2, F.col("best")).otherwise(F.col("only") - 1)
    return base.join(best, key, "left").select(*key, "base", (F.col("base") + 2 * F.coalesce(more, F.lit(0))).cast("int").alias("closure"))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure_of(gains(spark, sf_dir), scored(spark, sf_dir), ["trajectory", "ply"])


CLOSURES = f"""ev AS (SELECT trajectory, ply, {_EVALUATED.replace("s1", "a.s").replace("s2", "c.s")} AS base FROM p JOIN sc a ON p.p1 = a.b JOIN sc c ON p.p2 = c.b),
 tp AS (SELECT trajectory, ply, list_sort(list(opponent_gain), 'DESC') AS o FROM g GROUP BY 1, 2),
 pr AS (SELECT g.trajectory, g.ply, CASE WHEN len(any_value(o)) = 1 THEN max(own_gain) - 1 ELSE max(own_gain - CASE WHEN opponent_gain = o[1] AND o[2] < o[1] THEN o[2] ELSE o[1] END) END AS best FROM g JOIN tp USING (trajectory, ply) GROUP BY 1, 2),
 cl AS (SELECT trajectory, ply, CAST(base AS INT) AS base, CAST(base + 2 * coalesce(best, 0) AS INT) AS closure FROM ev LEFT JOIN pr USING (trajectory, ply))"""
_CLOSURE = f"{_GAINS}, {CLOSURES} SELECT * FROM cl"


def gain_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top gains, counts over thresholds, contested and unique best cells, and the least denial among the best moves."""
    df = _row_arrays(gains(spark, sf_dir), ["trajectory", "ply"])
    by = Window.partitionBy("trajectory", "ply")
    margin = F.col("own_gain") - F.col("reply_value")
    best_own, n_best = F.max("own_gain").over(by), F.sum((F.col("opponent_gain") == F.col("best_reply")).cast("int")).over(by)
    df = df.withColumns({"best_own": best_own, "n_best": n_best})
    df = df.withColumn("reply_value", F.when((F.col("n_best") == 1) & (F.col("opponent_gain") == F.col("best_reply")), F.coalesce("reply", F.lit(0))).otherwise(F.col("best_reply")))
    df = df.withColumn("best_margin", F.max(margin).over(by))

    def top(c: str, k: int) -> Column:
        return F.coalesce(F.get(F.sort_array(F.collect_list(c), asc=False), F.lit(k - 1)), F.lit(0)).cast("int")

    out = [top(f"{who}_gain", k).alias(f"{who}_gain_rank_{k}") for who in ("own", "opponent") for k in range(1, 5)]
    out += [F.count_if(F.col(f"{who}_gain") >= t).cast("int").alias(f"{who}_count_ge_{t}") for who in ("own", "opponent") for t in (2, 4, 8, 16)]
    out += [F.max(((F.col("own_gain") == F.col("best_own")) & (F.col("opponent_gain") == F.col("best_reply"))).cast("int")).alias("contested_best_square"), F.max((F.col("n_best") == 1).cast("int")).alias("opponent_unique_best_square"), F.min(F.when(margin == F.col("best_margin"), F.col("best_reply") - F.col("reply_value"))).cast("int").alias("denied_opponent_best_gain")]
    return df.groupBy("trajectory", "ply").agg(*out)


_TOPS = ", ".join(f"CAST(coalesce(list_sort(list({w}_gain), 'DESC')[{k}], 0) AS INT) AS {w}_gain_rank_{k}" for w in ("own", "opponent") for k in range(1, 5))
_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE {w}_gain >= {t}) AS INT) AS {w}_count_ge_{t}" for w in ("own", "opponent") for t in (2, 4, 8, 16))
_SUMMARIES = _GAINS + f""", m AS (SELECT trajectory, ply, max(own_gain) AS mo, max(opponent_gain) AS mr, coalesce(list_sort(list(opponent_gain), 'DESC')[2], 0) AS second FROM g GROUP BY 1, 2),
 u AS (SELECT g.*, mo, mr, count(*) FILTER (WHERE opponent_gain = mr) OVER (PARTITION BY trajectory, ply) AS ties, second FROM g JOIN m USING (trajectory, ply)),
 v AS (SELECT *, CASE WHEN ties = 1 AND opponent_gain = mr THEN second ELSE mr END AS rv FROM u), z AS (SELECT *, max(own_gain - rv) OVER (PARTITION BY trajectory, ply) AS top FROM v)
SELECT trajectory, ply, {_TOPS}, {_COUNTS}, max(CAST(own_gain = mo AND opponent_gain = mr AS INT)) AS contested_best_square, max(CAST(ties = 1 AS INT)) AS opponent_unique_best_square,
  CAST(min(mr - rv) FILTER (WHERE own_gain - rv = top) AS INT) AS denied_opponent_best_gain FROM z GROUP BY 1, 2"""


def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of reversal orbits of the 36 line patterns, by phase of the position source."""
    df = positions(spark, sf_dir)
    first = F.col("side") == 0
    staged = df.withColumns({"own": F.when(first, F.col("p1")).otherwise(F.col("p2")), "other": F.when(first, F.col("p2")).otherwise(F.col("p1"))})
    lines = B.scoring_lines()
    cells = [(k, c, 3**j) for k, line in enumerate(lines) for j, c in enumerate(line)]
    weights = spark.createDataFrame(cells, "line int, at int, weight int")  # 204 rows
    offsets = F.element_at(F.array(*[F.lit(B.pattern_offset(len(x))) for x in lines]), F.col("line") + 1)
    digit = F.when(B.has(F.col("own"), F.col("at")), 1).when(B.has(F.col("other"), F.col("at")), 2).otherwise(0)
    codes = staged.crossJoin(F.broadcast(weights)).groupBy("trajectory", "ply", "line").agg(F.sum(digit * F.col("weight")).alias("code"))
    ids = codes.select(phase_of(F.col("ply"), SOURCE_PHASES).alias("phase"), (F.col("code") + offsets).cast("int").alias("pattern"))
    orbits = spark.createDataFrame(list(enumerate(B.reversal_orbits())), "pattern int, orbit int")  # 3276 rows
    return ids.join(F.broadcast(orbits), "pattern").groupBy("phase", "orbit").agg(F.count("*").alias("n"))


_PATTERNS = f"""WITH p AS ({POSITIONS_DUCK}), l AS (SELECT * FROM (VALUES {_lines_values()}) v(line, pos, cell, size)),
 k AS (SELECT trajectory, p.ply, line, size, sum(CASE WHEN ((CASE WHEN side = 0 THEN p1 ELSE p2 END) >> l.cell) & 1 = 1 THEN 1 WHEN ((CASE WHEN side = 0 THEN p2 ELSE p1 END) >> l.cell) & 1 = 1 THEN 2 ELSE 0 END * CAST(power(3, pos) AS INT)) AS code,
   sum(CASE WHEN ((CASE WHEN side = 0 THEN p1 ELSE p2 END) >> l.cell) & 1 = 1 THEN 1 WHEN ((CASE WHEN side = 0 THEN p2 ELSE p1 END) >> l.cell) & 1 = 1 THEN 2 ELSE 0 END * CAST(power(3, size - 1 - pos) AS INT)) AS back FROM p, l GROUP BY trajectory, p.ply, line, size),
 d AS (SELECT n AS size, c AS code, (SELECT sum(((c // CAST(power(3, i) AS BIGINT)) % 3) * CAST(power(3, n - 1 - i) AS INT)) FROM range(n) r(i)) AS back FROM range(2, 8) s(n), range(2187) t(c) WHERE c < power(3, n)),
 o AS (SELECT size, code, CAST(row_number() OVER (ORDER BY size, code) - 1 AS INT) AS orbit FROM d WHERE code <= back)
SELECT {_phase_case(SOURCE_PHASES)} AS phase, orbit, count(*) AS n FROM k JOIN o ON o.size = k.size AND o.code = least(k.code, k.back) GROUP BY 1, 2"""


def systematic_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of first moves, one a canonical position: the first in order of the moves."""
    cells = spark.range(49)
    pairs = cells.select(F.col("id").cast("int").alias("a")).crossJoin(cells.select(F.col("id").cast("int").alias("b"))).filter("a <> b")  # 49 x 48
    boards = pairs.select("a", "b", B.bit(F.col("a")).alias("p1"), B.bit(F.col("b")).alias("p2"), F.lit(0).alias("side"))
    kept = B.with_canonical(boards).groupBy("canonical_low", "canonical_high").agg(F.min(F.struct("a", "b")).alias("m"), F.count("*").alias("n"))
    return kept.select(F.concat_ws(" ", B.format_move(F.col("m.a")), B.format_move(F.col("m.b"))).alias("moves"), "n")


_OPENINGS = f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({k}, {c}, {B.transform_cell(k, c)})" for k in range(8) for c in range(49))}) v(k, f, g)),
 x AS (SELECT x.f AS a, y.f AS b, x.k, (x.g, y.g) AS im FROM t x JOIN t y ON x.k = y.k AND x.f <> y.f), o AS (SELECT a, b, min((CAST(1 AS BIGINT) << im[1], CAST(1 AS BIGINT) << im[2])) AS c FROM x GROUP BY 1, 2),
 f AS (SELECT min((a, b)) AS m, count(*) AS n FROM o GROUP BY c)
SELECT chr(CAST(97 + m[1] % 7 AS INT)) || CAST(m[1] // 7 + 1 AS VARCHAR) || ' ' || chr(CAST(97 + m[2] % 7 AS INT)) || CAST(m[2] // 7 + 1 AS VARCHAR) AS moves, n FROM f"""


def greedy_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-legal and greedy policies on every position with an empty cell: the lowest empty cell, and the largest own gain (first cell on ties)."""
    df = gains(spark, sf_dir)
    return df.groupBy("trajectory", "ply").agg(F.min("cell").alias("first_legal"), F.max(F.struct("own_gain", (-F.col("cell")).alias("c"))).alias("m")).select("trajectory", "ply", "first_legal", (-F.col("m.c")).alias("greedy"), F.col("m.own_gain").alias("greedy_gain"))


_GREEDY = _GAINS + "SELECT trajectory, ply, min(cell) AS first_legal, arg_max(cell, own_gain * 100 - cell) AS greedy, max(own_gain) AS greedy_gain FROM g GROUP BY 1, 2"


def successor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root moves of every position that lead to the same canonical position, as groups: their representative and members."""
    df = positions(spark, sf_dir)
    moved = B.explode_empty(df, F.col("p1").bitwiseOR(F.col("p2")), "move")
    first = F.col("side") == 0
    child = moved.select("trajectory", "ply", "move", F.when(first, F.col("p1").bitwiseOR(B.bit(F.col("move")))).otherwise(F.col("p1")).alias("p1"), F.when(first, F.col("p2")).otherwise(F.col("p2").bitwiseOR(B.bit(F.col("move")))).alias("p2"), (1 - F.col("side")).alias("side"))
    return B.with_canonical(child).groupBy("trajectory", "ply", "canonical_low", "canonical_high").agg(F.min("move").alias("representative"), F.count("*").alias("moves")).select("trajectory", "ply", "representative", "moves")


_SUCCESSORS = f"""WITH p AS ({POSITIONS_DUCK}), t AS (SELECT * FROM (VALUES {", ".join(f"({k}, {c}, {B.transform_cell(k, c)})" for k in range(8) for c in range(49))}) v(k, f, g)),
 ch AS (SELECT trajectory, ply, CAST(m AS INT) AS move, CASE WHEN side = 0 THEN p1 | (CAST(1 AS BIGINT) << m) ELSE p1 END AS a, CASE WHEN side = 0 THEN p2 ELSE p2 | (CAST(1 AS BIGINT) << m) END AS b FROM p, range(49) r(m) WHERE ((p1 | p2) >> m) & 1 = 0),
 im AS (SELECT trajectory, ply, move, k, bit_or(CASE WHEN (a >> f) & 1 = 1 THEN CAST(1 AS BIGINT) << g ELSE 0 END) AS x, bit_or(CASE WHEN (b >> f) & 1 = 1 THEN CAST(1 AS BIGINT) << g ELSE 0 END) AS y FROM ch, t GROUP BY 1, 2, 3, 4),
 c AS (SELECT trajectory, ply, move, min((x, y)) AS key FROM im GROUP BY 1, 2, 3)
SELECT trajectory, ply, min(move) AS representative, count(*) AS moves FROM c GROUP BY trajectory, ply, key"""

QUERIES = {
    "eval_metrics_by_phase": (eval_metrics_by_phase, _EVAL_METRICS),
    "position_scores": (position_scores, _POSITION_SCORES),
    "canonical_positions": (canonical_positions, _CANONICAL),
    "corpus_dedup": (corpus_dedup, _DEDUP),
    "dedup_summary": (dedup_summary, _DEDUP_SUMMARY),
    "trajectory_components": (trajectory_components, _COMPONENTS),
    "group_integrity": (group_integrity, _INTEGRITY),
    "move_gains": (move_gains, _MOVE_GAINS),
    "closure_evaluation": (closure, _CLOSURE),
    "gain_summaries": (gain_summaries, _SUMMARIES),
    "line_pattern_orbits": (line_patterns, _PATTERNS),
    "systematic_openings": (systematic_openings, _OPENINGS),
    "baseline_policies": (greedy_moves, _GREEDY),
    "successor_groups": (successor_groups, _SUCCESSORS),
}
