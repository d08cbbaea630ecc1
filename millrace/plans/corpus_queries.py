"""Checks of moves and records, targets of labels, openings, digests, provenance and reports of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import bitboard as B
from millrace.operators.corpus import SOURCE_PHASES, phase_of
from millrace.plans import board_queries as Q
from millrace.plans.adapters import POSITIONS_DUCK, games, labels, labels_sql, positions, table
from millrace.plans.board_queries import _canonical_sql, _phase_case, duck_scores
from millrace.plans.report_queries import _PAIRS, _SERIES, halves, pairs, series_summary
from millrace.sources.scratch import materialize

_TRIED = "(ply * 13 + trajectory * 5) % 58"


def move_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move tried on every position, in text: why it is refused, or the boards after it."""
    tried = F.expr(_TRIED).cast("int")
    text = F.concat(F.when(F.col("ply") % 2 == 0, F.chr(97 + tried % 7)).otherwise(F.chr(65 + tried % 7)), (F.floor(tried / 7) + 1).cast("string"))
    df = positions(spark, sf_dir).withColumn("move", text)
    error, cell = B.valid_move(F.col("move"), F.col("p1"), F.col("p2")), F.coalesce(B.parse_move(F.col("move")), F.lit(0))
    p1, p2 = B.place(F.col("p1"), F.col("p2"), F.col("side"), cell)
    return df.select("trajectory", "ply", "move", error.alias("error"), F.when(error.isNull(), p1).alias("p1"), F.when(error.isNull(), p2).alias("p2"))


_MOVE_CHECKS = f"""WITH p AS ({POSITIONS_DUCK}), x AS (SELECT *, CAST({_TRIED} AS INT) AS t FROM p),
 y AS (SELECT *, chr(CAST((CASE WHEN ply % 2 = 0 THEN 97 ELSE 65 END) + t % 7 AS INT)) || CAST(t // 7 + 1 AS VARCHAR) AS move, CASE WHEN t >= 49 THEN 'out_of_bounds' WHEN ply = 49 THEN 'game_over' WHEN ((p1 | p2) >> t) & 1 = 1 THEN 'occupied' END AS error FROM x)
SELECT trajectory, ply, move, error, CASE WHEN error IS NULL THEN CASE WHEN side = 0 THEN p1 | (CAST(1 AS BIGINT) << t) ELSE p1 END END AS p1, CASE WHEN error IS NULL THEN CASE WHEN side = 0 THEN p2 ELSE p2 | (CAST(1 AS BIGINT) << t) END END AS p2 FROM y"""


def replayed_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trajectory's moves played again from the empty board: its boards, length and winner."""
    moves = positions(spark, sf_dir).groupBy("trajectory").agg(F.transform(F.sort_array(F.collect_list(F.struct("ply", "cell"))), lambda x: x["cell"]).alias("moves"))  # at most 49 a trajectory
    played = moves.select("trajectory", B.replay(F.col("moves")).alias("r")).select("trajectory", "r.*")
    return B.with_scores(played, s1="p1", s2="p2").select("trajectory", "p1", "p2", "ply", (F.col("ply") == B.CELLS).alias("finished"), B.winner(F.col("s1"), F.col("s2")).alias("leader"))


_REPLAYED = f"""WITH p AS ({POSITIONS_DUCK}), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY trajectory ORDER BY ply DESC) = 1), sc AS ({duck_scores("l")})
SELECT trajectory, p1, p2, CAST(ply AS INT) AS ply, ply = 49 AS finished, CASE WHEN 2 * a.s > 2 * c.s + 11 THEN 'p1' ELSE 'p2' END AS leader FROM l JOIN sc a ON p1 = a.b JOIN sc c ON p2 = c.b"""


def position_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusive-or hash of the pieces of every position and of its side to move."""
    return B.with_hash(positions(spark, sf_dir), ["trajectory", "ply"])


def _mix_sql(x: str, name: str, source: str, keep: str) -> str:
    """CTEs that add ``z``, a step of the generator from x, to a relation."""
    wrap = "% 18446744073709551616::UHUGEINT"
    return f"""{name}0 AS (SELECT {keep}, ({x}) {wrap} AS z FROM {source}), {name}1 AS (SELECT {keep}, (z + 11400714819323198485::UHUGEINT) {wrap} AS z FROM {name}0),
 {name}2 AS (SELECT {keep}, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) {wrap} AS z FROM {name}1), {name}3 AS (SELECT {keep}, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) {wrap} AS z FROM {name}2),
 {name} AS (SELECT {keep}, xor(z, z >> 31)::UBIGINT AS z FROM {name}3)"""


_HASHES = f"""WITH p AS ({POSITIONS_DUCK}), pc AS (SELECT l.range AS player, c.range AS cell FROM range(2) l, range(49) c),
 {_mix_sql(f"xor({B.PIECE_SEED}::UHUGEINT, (player * 4294967296 + cell)::UHUGEINT)", "zp", "pc", "player, cell")}, one AS (SELECT 1 AS i), {_mix_sql(f"{B.SIDE_SEED}::UHUGEINT", "zs", "one", "i")},
 h AS (SELECT trajectory, p.ply, any_value(side) AS side, bit_xor(zp.z) AS x FROM p JOIN zp ON ((CASE WHEN player = 0 THEN p1 ELSE p2 END) >> zp.cell) & 1 = 1 GROUP BY 1, 2),
 u AS (SELECT trajectory, ply, CASE WHEN side = 1 THEN xor(x, (SELECT z FROM zs)) ELSE x END AS x FROM h)
SELECT trajectory, ply, CAST(CASE WHEN x >= 9223372036854775808 THEN x::HUGEINT - 18446744073709551616 ELSE x::HUGEINT END AS BIGINT) AS hash FROM u"""


def move_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits of the empty cells of every position under its own symmetries: representative and size."""
    df = B.with_canonical(positions(spark, sf_dir)).select("trajectory", "ply", "p1", "p2", "stabilizer")
    empty = B.explode_empty(materialize(df, "stabilizers"), F.col("p1").bitwiseOR(F.col("p2")))
    return empty.groupBy("trajectory", "ply", B.move_orbit(F.col("stabilizer"), F.col("cell")).alias("representative")).agg(F.count("*").alias("cells"))


_ORBITS = f"""WITH {_canonical_sql()}, s AS (SELECT c.trajectory, c.ply, stabilizer, p1, p2 FROM c JOIN p USING (trajectory, ply)),
 m AS (SELECT s.trajectory, s.ply, t.cell_from, min(t.cell_to) AS representative FROM s JOIN t ON (s.stabilizer >> t.k) & 1 = 1 AND ((p1 | p2) >> t.cell_from) & 1 = 0 GROUP BY 1, 2, 3)
SELECT trajectory, ply, CAST(representative AS INT) AS representative, count(*) AS cells FROM m GROUP BY 1, 2, 3"""

#: Records with faults put in by rule, so that every rule of the audit has something to find.
_AUDITED = """SELECT trajectory, CASE WHEN (trajectory + ply) % 53 = 0 THEN p1 | p2 ELSE p1 END AS p1, p2, CASE WHEN (trajectory * 3 + ply) % 61 = 0 THEN 1 - side ELSE side END AS side, CASE WHEN trajectory % 11 = 0 AND ply = 9 THEN 8 ELSE ply END AS ply,
  CAST(CASE WHEN (trajectory + ply) % 97 = 0 THEN 5 ELSE 1 + trajectory % 4 END AS INT) AS policy, CAST(CASE WHEN (trajectory * 7 + ply) % 89 = 0 THEN 0 ELSE 1 + trajectory % 3 END AS INT) AS split, CASE WHEN (trajectory + ply) % 71 = 0 THEN 0 ELSE trajectory + 1 END AS family, ply AS sample FROM {p}"""


def position_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the rules of position records, by rule: boards, pieces, side, known policy and split, ids, order, constant
    columns within a trajectory, one sample a phase, and families or keys that cross splits."""
    df = materialize(spark.sql(_AUDITED.format(p="{p}"), p=positions(spark, sf_dir)), "audited")
    w = Window.partitionBy("trajectory").orderBy("sample")
    ordered = df.withColumn("earlier", F.lag("ply").over(w))
    rules = {
        "overlap": F.col("p1").bitwiseAND(F.col("p2")) != 0, "pieces": (F.bit_count("p1") != F.floor((F.col("ply") + 1) / 2)) | (F.bit_count("p2") != F.floor(F.col("ply") / 2)), "side": F.col("side") != F.col("ply") % 2,
        "policy": ~F.col("policy").between(1, 4), "split": ~F.col("split").between(1, 3), "zero_id": F.col("family") == 0, "order": F.col("ply") <= F.col("earlier"),
    }
    rows = ordered.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    first = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))
    phases = df.groupBy("trajectory").agg(F.count_distinct("family").alias("f"), F.count_distinct("policy").alias("p"), F.count_distinct("split").alias("s"), F.count("*").alias("n"), F.count_distinct(phase_of(F.col("ply"), SOURCE_PHASES)).alias("ph"))
    within = phases.agg(F.count_if(F.greatest("f", "p", "s") > 1).alias("metadata"), F.count_if(F.col("n") != F.col("ph")).alias("phase_samples"))
    second = within.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in ("metadata", "phase_samples")])))
    crossing = [df.groupBy(*keys).agg(F.count_distinct("split").alias("n")).agg(F.lit(f"{name}_crosses_splits").alias("rule"), F.count_if(F.col("n") > 1).alias("violations")) for name, keys in (("family", ["family"]), ("board", ["p1", "p2"]))]
    return first.unionByName(second).unionByName(crossing[0]).unionByName(crossing[1])


_AUDIT = f"""WITH a AS ({_AUDITED.format(p=f"({POSITIONS_DUCK})")}), o AS (SELECT *, lag(ply) OVER (PARTITION BY trajectory ORDER BY sample) AS earlier FROM a),
 t AS (SELECT trajectory, count(*) AS n, count(DISTINCT {_phase_case(SOURCE_PHASES)}) AS ph, greatest(count(DISTINCT family), count(DISTINCT policy), count(DISTINCT split)) AS m FROM a GROUP BY 1)
SELECT 'overlap' AS rule, count(*) AS violations FROM a WHERE p1 & p2 <> 0 UNION ALL SELECT 'pieces', count(*) FROM a WHERE bit_count(p1) <> (ply + 1) // 2 OR bit_count(p2) <> ply // 2 UNION ALL SELECT 'side', count(*) FROM a WHERE side <> ply % 2
UNION ALL SELECT 'policy', count(*) FROM a WHERE policy NOT BETWEEN 1 AND 4 UNION ALL SELECT 'split', count(*) FROM a WHERE split NOT BETWEEN 1 AND 3 UNION ALL SELECT 'zero_id', count(*) FROM a WHERE family = 0
UNION ALL SELECT 'order', count(*) FROM o WHERE ply <= earlier UNION ALL SELECT 'metadata', count(*) FROM t WHERE m > 1 UNION ALL SELECT 'phase_samples', count(*) FROM t WHERE n <> ph
UNION ALL SELECT 'family_crosses_splits', count(*) FROM (SELECT family FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'board_crosses_splits', count(*) FROM (SELECT p1, p2 FROM a GROUP BY 1, 2 HAVING count(DISTINCT split) > 1)"""

#: Completed search iterations of every record, with their number by rule; the deepest is dropped where it is 0.
_ITERATIONS = "SELECT ordinal, ply, d AS depth, CAST((value * 3 + d * 7 + nodes) % 61 - 30 AS INT) AS value, nodes * d AS nodes, 49 - ply AS empties FROM {a}"


def label_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The iteration that labels each record: the deepest if its depth has the parity of the terminal depth, else the one before, else none."""
    a = labels(spark, sf_dir, "a").groupBy("ordinal").agg(F.min(F.struct("ply", "value", "nodes", "depth")).alias("r")).select("ordinal", "r.*")  # the first of repeated ordinals
    a = a.withColumn("d", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    runs = spark.sql(_ITERATIONS, a=a)
    last = F.struct("depth", "value", "nodes")
    both = runs.groupBy("ordinal", "empties").agg(F.max(last).alias("deepest"), F.max_by(F.struct("value", "nodes"), "depth").alias("x"), F.array_sort(F.collect_list(last), lambda p, q: q["depth"] - p["depth"]).alias("all"))  # at most six a record
    before = F.get("all", F.lit(1))
    terminal = F.when(F.col("empties") <= 2, F.col("empties")).otherwise(F.greatest(F.lit(1), F.col("empties") - 2))
    same = F.pmod(F.col("deepest.depth"), F.lit(2)) == F.pmod(terminal, F.lit(2))
    target = F.when(same, F.col("deepest")).otherwise(before)
    out = both.select("ordinal", terminal.cast("int").alias("terminal_depth"), F.col("deepest.depth").alias("deepest_depth"), before["depth"].alias("previous_depth"), target["depth"].alias("depth"), target["value"].alias("value"), target["nodes"].alias("nodes"), (~same).alias("backed_off"))
    return out.filter("depth IS NOT NULL")


_TARGETS = f"""WITH a AS (SELECT * FROM ({labels_sql("a")}) QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY ply, value, nodes, depth) = 1), r AS ({_ITERATIONS.format(a="(SELECT *, CAST(unnest(range(1, depth + 1)) AS INT) AS d FROM a)")}),
 w AS (SELECT *, CASE WHEN empties <= 2 THEN empties ELSE greatest(1, empties - 2) END AS terminal_depth, max(depth) OVER (PARTITION BY ordinal) AS deepest_depth FROM r),
 x AS (SELECT *, CASE WHEN deepest_depth % 2 = terminal_depth % 2 THEN deepest_depth ELSE deepest_depth - 1 END AS wanted FROM w)
SELECT ordinal, CAST(terminal_depth AS INT) AS terminal_depth, deepest_depth, CASE WHEN deepest_depth > 1 THEN deepest_depth - 1 END AS previous_depth, depth, value, nodes, deepest_depth % 2 <> terminal_depth % 2 AS backed_off FROM x WHERE depth = wanted"""


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the rules between two labellings of the same records, joined one to one: missing rows, unequal sources, repeated
    ordinals, depths beyond the terminal one, best moves off the board, and equal depths with unequal values."""
    a, b = labels(spark, sf_dir, "a"), labels(spark, sf_dir, "b").filter("ordinal % 101 <> 0")
    b = b.select("ordinal", *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "ordinal"])
    both = a.join(b, "ordinal", "full_outer")
    rules = {
        "missing": F.col("ply").isNull() | F.col("ply_b").isNull(), "unequal_source": (F.col("ply") != F.col("ply_b")) | (F.col("policy") != F.col("policy_b")), "beyond_terminal": F.col("depth_b") > F.col("terminal_depth_b"),
        "best_move": ~F.col("best_move_b").between(0, 48), "varying_value": (F.col("depth") == F.col("depth_b")) & (F.col("value") != F.col("value_b")), "deeper_with_fewer_nodes": (F.col("depth") < F.col("depth_b")) & (F.col("nodes") > F.col("nodes_b")),
    }
    counted = both.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))
    repeated = a.groupBy("ordinal").count().agg(F.lit("repeated_ordinal").alias("rule"), F.count_if(F.col("count") > 1).alias("violations"))
    return counted.unionByName(repeated)


_LABEL_AUDIT = f"""WITH a AS ({labels_sql("a")}), b AS (SELECT * FROM ({labels_sql("b")}) WHERE ordinal % 101 <> 0), j AS (SELECT a.ply, b.ply AS ply_b, a.policy, b.policy AS policy_b, a.depth, b.depth AS depth_b, b.terminal_depth AS terminal_depth_b, b.best_move AS best_move_b, a.value, b.value AS value_b, a.nodes, b.nodes AS nodes_b FROM a FULL JOIN b USING (ordinal))
SELECT 'missing' AS rule, count(*) AS violations FROM j WHERE ply IS NULL OR ply_b IS NULL UNION ALL SELECT 'unequal_source', count(*) FROM j WHERE ply <> ply_b OR policy <> policy_b UNION ALL SELECT 'beyond_terminal', count(*) FROM j WHERE depth_b > terminal_depth_b
UNION ALL SELECT 'best_move', count(*) FROM j WHERE best_move_b NOT BETWEEN 0 AND 48 UNION ALL SELECT 'varying_value', count(*) FROM j WHERE depth = depth_b AND value <> value_b UNION ALL SELECT 'deeper_with_fewer_nodes', count(*) FROM j WHERE depth < depth_b AND nodes > nodes_b
UNION ALL SELECT 'repeated_ordinal', count(*) FROM (SELECT ordinal FROM a GROUP BY 1 HAVING count(*) > 1)"""


def label_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelling's depths and parities: count, least, median, mean, largest and the sorted histogram, overall and by policy."""
    both = [labels(spark, sf_dir, k).withColumn("dataset", F.lit(k)) for k in "ab"]
    df = both[0].unionByName(both[1])
    counted = df.groupBy("dataset", "policy", "depth").agg(F.count("*").alias("n"))
    histogram = lambda *keys: counted.groupBy(*keys, "depth").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "n"))), lambda x: F.concat_ws(":", x["depth"], x["n"])), " ").alias("histogram"))
    measures = [F.count("*").alias("n"), F.min("depth").alias("minimum"), F.percentile("depth", 0.5).alias("median"), F.round(F.avg("depth"), 6).alias("mean"), F.max("depth").alias("maximum"), F.sum("nodes").alias("nodes")]
    whole = df.groupBy("dataset").agg(*measures).join(histogram("dataset"), "dataset").withColumn("policy", F.lit(0))
    each = df.groupBy("dataset", "policy").agg(*measures).join(histogram("dataset", "policy"), ["dataset", "policy"])
    return whole.unionByName(each)


_HISTOGRAMS = f"""WITH u AS (SELECT 'a' AS dataset, * FROM ({labels_sql("a")}) UNION ALL SELECT 'b', * FROM ({labels_sql("b")})), x AS (SELECT dataset, 0 AS policy, depth, nodes FROM u UNION ALL SELECT dataset, policy, depth, nodes FROM u),
 h AS (SELECT dataset, policy, string_agg(depth || ':' || n, ' ' ORDER BY depth) AS histogram FROM (SELECT dataset, policy, depth, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT dataset, policy, n, minimum, median, mean, maximum, nodes, histogram FROM (SELECT dataset, policy, count(*) AS n, min(depth) AS minimum, median(CAST(depth AS DOUBLE)) AS median, round(avg(depth), 6) AS mean, max(depth) AS maximum, CAST(sum(nodes) AS BIGINT) AS nodes FROM x GROUP BY 1, 2) JOIN h USING (dataset, policy)"""


def corpus_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on a corpus: records, trajectories, distinct and duplicate positions, groups that cross splits or vary, rows by policy."""
    df = Q.corpus_records(spark, sf_dir)
    df = materialize(df.withColumns({"split": F.pmod("trajectory", F.lit(3)), "policy": F.pmod("trajectory", F.lit(4))}), "records")
    key = ["canonical_low", "canonical_high"]
    one = df.agg(F.count("*").alias("records"), F.count_distinct("trajectory").alias("trajectories"), *[F.count_if(F.col("policy") == k).alias(f"policy_{k}") for k in range(4)], *[F.count_if(F.col("split") == k).alias(f"split_{k}") for k in range(3)])
    depths = df.groupBy(*key, "depth").agg(F.count_distinct("value").alias("v"))
    groups = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("split").alias("s")).join(depths.groupBy(*key).agg(F.max("v").alias("v")), key)
    two = groups.agg(F.count("*").alias("unique_positions"), F.max("n").alias("maximum_duplicate_count"), F.count_if(F.col("s") > 1).alias("crossing_groups"), F.count_if(F.col("v") > 1).alias("varying_groups"))
    return one.crossJoin(two)  # a row each


_PREFLIGHT = f"""WITH {Q._RECORDS}, r AS (SELECT *, trajectory % 3 AS split, trajectory % 4 AS policy FROM rec), d AS (SELECT canonical_low, canonical_high, depth, count(DISTINCT value) AS v FROM r GROUP BY 1, 2, 3),
 q AS (SELECT canonical_low, canonical_high, count(*) AS n, count(DISTINCT split) AS s FROM r GROUP BY 1, 2), dv AS (SELECT canonical_low, canonical_high, max(v) AS v FROM d GROUP BY 1, 2), j AS (SELECT * FROM q JOIN dv USING (canonical_low, canonical_high))
SELECT (SELECT count(*) FROM r) AS records, (SELECT count(DISTINCT trajectory) FROM r) AS trajectories, {", ".join(f"(SELECT count(*) FROM r WHERE policy = {k}) AS policy_{k}" for k in range(4))}, {", ".join(f"(SELECT count(*) FROM r WHERE split = {k}) AS split_{k}" for k in range(3))},
  count(*) AS unique_positions, max(n) AS maximum_duplicate_count, count(*) FILTER (WHERE s > 1) AS crossing_groups, count(*) FILTER (WHERE v > 1) AS varying_groups FROM j"""


def shard_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nodes and a digest of every shard of labels, in order, and the digest of the shards' digests."""
    df = labels(spark, sf_dir, "a").withColumn("shard", F.floor(F.col("ordinal") / 4096).cast("int"))  # a shard is a contiguous range of bounded size
    rows = df.select("shard", "ordinal", "nodes", F.sha2(F.concat_ws("|", "ordinal", "value", "depth", "best_move"), 256).alias("d"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "d"))), lambda x: x["d"])
    each = rows.groupBy("shard").agg(F.count("*").alias("records"), F.sum("nodes").alias("nodes"), F.sha2(F.array_join(lines, ""), 256).alias("digest"))
    folded = F.transform(F.array_sort(F.collect_list(F.struct("shard", "digest"))), lambda x: x["digest"])  # a line a shard
    whole = each.agg(F.lit(-1).alias("shard"), F.sum("records").alias("records"), F.sum("nodes").alias("nodes"), F.sha2(F.array_join(folded, ""), 256).alias("digest"))
    return each.unionByName(whole)


_DIGESTS = f"""WITH a AS (SELECT *, CAST(ordinal // 4096 AS INT) AS shard FROM ({labels_sql("a")})), e AS (SELECT shard, count(*) AS records, CAST(sum(nodes) AS BIGINT) AS nodes, sha256(string_agg(sha256(ordinal || '|' || value || '|' || depth || '|' || best_move), '' ORDER BY ordinal, sha256(ordinal || '|' || value || '|' || depth || '|' || best_move))) AS digest FROM a GROUP BY 1)
SELECT * FROM e UNION ALL SELECT -1, CAST(sum(records) AS BIGINT), CAST(sum(nodes) AS BIGINT), sha256(string_agg(digest, '' ORDER BY shard)) FROM e"""


def search_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``name value`` pairs of a search log, parsed, and its summary by engine: speed, depths and totals, with the ratio to the first engine."""
    line = "concat('info depth ', 1 + l_partkey % 9, ' nodes ', 1000 + l_orderkey % 7777, ' time ', 1 + l_suppkey % 97, ' engine ', l_linenumber % 2)"
    lines = table(spark, sf_dir, "lineitem").select(F.expr(line).alias("line"))
    words = F.split(F.expr("substring(line, 6)"), " ")
    parsed = lines.select(F.map_from_entries(F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int") - 1), lambda k: F.struct(F.get(words, 2 * k), F.get(words, 2 * k + 1)))).alias("m"))
    df = parsed.select(F.col("m")["engine"].alias("engine"), *[F.col("m")[c].cast("long").alias(c) for c in ("depth", "nodes", "time")])
    out = df.groupBy("engine").agg(F.count("*").alias("searches"), F.round(1000 * F.sum("nodes") / F.sum("time"), 4).alias("nodes_per_second"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.percentile("depth", 0.5).alias("median_depth"), F.min("depth").alias("least_depth"), F.max("depth").alias("largest_depth"), F.sum("nodes").alias("nodes"))
    first = out.agg(F.min_by("nodes_per_second", "engine").alias("f"))
    return out.crossJoin(first).withColumn("ratio", F.round(F.col("nodes_per_second") / F.nullif("f", F.lit(0.0)), 6)).drop("f")  # a row an engine


_SEARCH_LOG = """WITH x AS (SELECT CAST(l_linenumber % 2 AS VARCHAR) AS engine, 1 + l_partkey % 9 AS depth, 1000 + l_orderkey % 7777 AS nodes, 1 + l_suppkey % 97 AS time FROM lineitem),
 s AS (SELECT engine, count(*) AS searches, round(1000 * sum(nodes) / sum(time), 4) AS nodes_per_second, round(avg(depth), 6) AS mean_depth, median(CAST(depth AS DOUBLE)) AS median_depth, min(depth) AS least_depth, max(depth) AS largest_depth, CAST(sum(nodes) AS BIGINT) AS nodes FROM x GROUP BY 1)
SELECT *, round(nodes_per_second / (SELECT arg_min(nodes_per_second, engine) FROM s), 6) AS ratio FROM s"""


def opening_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of 4 to 9 plies with a small score gap, one a canonical position, up to a quota a depth by a hash, in two halves of equal size."""
    df = B.with_scores(positions(spark, sf_dir).filter("ply BETWEEN 4 AND 9"), s1="p1", s2="p2").filter("abs(s1 - s2) <= 4")
    keyed = materialize(B.with_canonical(df).select("ply", "canonical_low", "canonical_high").distinct(), "openings")
    h = F.md5(F.concat_ws(":", F.lit("7"), "ply", "canonical_low", "canonical_high"))
    w = Window.partitionBy("ply").orderBy(h, "canonical_low", "canonical_high")
    kept = keyed.withColumn("i", F.row_number().over(w)).filter("i <= 5 + ply * 3").drop("i")  # the quota is the operator's
    dealt = halves(kept, "ply", [h, F.col("canonical_low"), F.col("canonical_high")])
    return dealt.groupBy("half", "ply").agg(F.count("*").alias("openings"), F.min("canonical_low").alias("least_low"), F.max("canonical_low").alias("largest_low"))


_OPENING_CORPUS = f"""WITH {_canonical_sql()}, sc AS ({duck_scores("p")}), k AS (SELECT DISTINCT c.ply, canonical_low, canonical_high FROM c JOIN p USING (trajectory, ply) JOIN sc a ON p1 = a.b JOIN sc b ON p2 = b.b WHERE c.ply BETWEEN 4 AND 9 AND abs(a.s - b.s) <= 4),
 o AS (SELECT *, row_number() OVER (PARTITION BY ply ORDER BY md5('7:' || ply || ':' || canonical_low || ':' || canonical_high), canonical_low, canonical_high) AS i FROM k QUALIFY i <= 5 + ply * 3),
 cn AS (SELECT ply, count(*) AS n FROM o GROUP BY 1), tt AS (SELECT sum(n) // 2 - sum(n // 2) AS extras FROM cn), od AS (SELECT ply, row_number() OVER (ORDER BY ply) AS r FROM cn WHERE n % 2 = 1),
 qu AS (SELECT cn.ply, n // 2 + CASE WHEN r <= extras THEN 1 ELSE 0 END AS quota FROM cn LEFT JOIN od USING (ply), tt)
SELECT CASE WHEN i <= quota THEN 'a' ELSE 'b' END AS half, ply, count(*) AS openings, min(canonical_low) AS least_low, max(canonical_low) AS largest_low FROM o JOIN qu USING (ply) GROUP BY 1, 2"""


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th key of the sorted distinct positions, so that forty are spread evenly (the operator samples), and a seeded order of them."""
    df = materialize(Q.corpus_records(spark, sf_dir).select("canonical_low", "canonical_high").distinct(), "keys")
    n = df.count()
    wanted = spark.range(40).select(F.floor(F.col("id") * n / 40).alias("index")).distinct()  # 40 rows
    numbered = _numbered(df, ["canonical_low", "canonical_high"])
    seed = F.md5(F.concat_ws(":", F.lit("11"), "canonical_low", "canonical_high"))
    picked = numbered.join(F.broadcast(wanted), "index")
    return picked.withColumn("place", F.row_number().over(Window.orderBy(seed))).select("index", "canonical_low", "canonical_high", "place")


def _numbered(df: DataFrame, order: list[str], target: str = "index") -> DataFrame:
    """Number the rows in an order from 0 on: range partitions are counted, so no task has them all."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a partition
    within = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return within.join(F.broadcast(starts), "part").withColumn(target, (F.col("start") + F.col("i") - 1).cast("long")).drop("part", "i", "start")


_EVEN = f"""WITH {Q._RECORDS}, d AS (SELECT canonical_low, canonical_high, row_number() OVER (ORDER BY canonical_low, canonical_high) - 1 AS index, count(*) OVER () AS n FROM (SELECT DISTINCT canonical_low, canonical_high FROM rec)),
 w AS (SELECT DISTINCT CAST(floor(i * n / 40) AS BIGINT) AS index FROM range(40) r(i), (SELECT any_value(n) AS n FROM d))
SELECT index, canonical_low, canonical_high, row_number() OVER (ORDER BY md5('11:' || canonical_low || ':' || canonical_high)) AS place FROM d JOIN w USING (index)"""


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the union, intersection and differences of two shards' sets of keys, and whether they are equal."""
    df = materialize(Q.corpus_records(spark, sf_dir).select("shard", "canonical_low", "canonical_high").filter("shard < 2"), "keys")
    seen = df.groupBy("canonical_low", "canonical_high").agg(F.bool_or(F.col("shard") == 0).alias("a"), F.bool_or(F.col("shard") == 1).alias("b"))
    return seen.agg(F.count("*").alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"), F.coalesce(F.every(F.col("a") & F.col("b")), F.lit(True)).alias("equal"))


_SETS = f"""WITH {Q._RECORDS}, a AS (SELECT DISTINCT canonical_low, canonical_high FROM rec WHERE shard = 0), b AS (SELECT DISTINCT canonical_low, canonical_high FROM rec WHERE shard = 1)
SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_second,
  (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS equal"""


def series_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON on every series: results, averages guarded against no games, and pairs by points."""
    bins = pairs(games(spark, sf_dir)).groupBy("series").agg(*[F.count_if(F.col("bin") == k).alias(f"p{k}") for k in range(5)])
    df = series_summary(spark, sf_dir).join(bins, "series", "left")
    share = F.coalesce(F.round(F.col("plies") / F.nullif("games", F.lit(0)), 3), F.lit(0.0))
    return df.select("series", F.to_json(F.struct("games", "engine_one_wins", "engine_two_wins", "no_winner", "abnormal", share.cast("string").alias("mean_plies"), F.concat_ws(",", *[F.coalesce(f"p{k}", F.lit(0)) for k in range(5)]).alias("pairs"))).alias("report"))


_REPORT = f"""WITH s AS ({_SERIES}), {_PAIRS}, b AS (SELECT series, {", ".join(f"count(*) FILTER (WHERE bin = {k}) AS p{k}" for k in range(5))} FROM pr GROUP BY 1)
SELECT series, '{{"games":' || games || ',"engine_one_wins":' || engine_one_wins || ',"engine_two_wins":' || engine_two_wins || ',"no_winner":' || no_winner || ',"abnormal":' || abnormal || ',"mean_plies":"' || CAST(round(plies / games, 3) AS VARCHAR)
  || '","pairs":"' || {" || ',' || ".join(f"coalesce(p{k}, 0)" for k in range(5))} || '"}}' AS report FROM s LEFT JOIN b USING (series)"""


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a run from its events (a stage an event type and user group): attempts, state by precedence, seconds, first and last event; one left running is abandoned."""
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("stage"), "event_id", "ts", F.expr("CASE event_id % 5 WHEN 0 THEN 'started' WHEN 1 THEN 'progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'started' END").alias("type"), (F.col("event_id") % 13).alias("seconds"))
    order = F.struct("ts", "event_id")
    last = F.max_by("type", order)
    state = F.when(last == "failed", "failed").when(last == "completed", "complete").otherwise("abandoned")
    return df.groupBy("stage").agg(F.count_if(F.col("type") == "started").alias("attempts"), state.alias("state"), F.sum(F.when(F.col("type") == "completed", F.col("seconds")).otherwise(0)).alias("recorded_seconds"), F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"))


_STATUS = """WITH e AS (SELECT user_id % 40 AS stage, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'started' WHEN 1 THEN 'progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'started' END AS type, event_id % 13 AS seconds FROM events)
SELECT stage, count(*) FILTER (WHERE type = 'started') AS attempts, CASE arg_max(type, (ts, event_id)) WHEN 'failed' THEN 'failed' WHEN 'completed' THEN 'complete' ELSE 'abandoned' END AS state,
  CAST(sum(CASE WHEN type = 'completed' THEN seconds ELSE 0 END) AS BIGINT) AS recorded_seconds, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM e GROUP BY 1"""


def ledger_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of saved result rows against what their series says, by name: those that differ or that one side lacks."""
    df = series_summary(spark, sf_dir)
    fields = ["games", "engine_one_wins", "engine_two_wins", "no_winner", "abnormal", "plies"]
    want = df.select("series", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("expected")) for c in fields])).alias("x")).select("series", "x.*")
    saved = want.filter("NOT (series % 9 = 4 AND field = 'abnormal')").select("series", "field", F.when((F.col("series") % 7 == 2) & (F.col("field") == "plies"), F.concat("expected", F.lit("0"))).otherwise(F.col("expected")).alias("saved"))
    return want.join(saved, ["series", "field"], "full_outer").filter("NOT (expected <=> saved)")


_LEDGER = f"""WITH s AS ({_SERIES}), w AS (SELECT series, unnest(['games', 'engine_one_wins', 'engine_two_wins', 'no_winner', 'abnormal', 'plies']) AS field, CAST(unnest([games, engine_one_wins, engine_two_wins, no_winner, abnormal, plies]) AS VARCHAR) AS expected FROM s),
 v AS (SELECT series, field, CASE WHEN series % 7 = 2 AND field = 'plies' THEN expected || '0' ELSE expected END AS saved FROM w WHERE NOT (series % 9 = 4 AND field = 'abnormal'))
SELECT series, field, expected, saved FROM w FULL JOIN v USING (series, field) WHERE expected IS DISTINCT FROM saved"""


def provenance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards whose labels don't all come from one build and one search limit, with how many kinds they have."""
    df = labels(spark, sf_dir, "a").select(F.floor(F.col("ordinal") / 4096).cast("int").alias("shard"), F.struct((F.col("ordinal") / 8192).cast("int").alias("build"), F.when(F.col("ordinal") % 5003 == 0, 2).otherwise(1).alias("limit")).alias("made"))
    return df.groupBy("shard").agg(F.count_distinct("made").alias("kinds")).filter("kinds > 1")


_PROVENANCE = f"""SELECT CAST(ordinal // 4096 AS INT) AS shard, count(DISTINCT (ordinal // 8192, CASE WHEN ordinal % 5003 = 0 THEN 2 ELSE 1 END)) AS kinds FROM ({labels_sql("a")}) GROUP BY 1 HAVING kinds > 1"""

def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a position source as one line of JSON: records, trajectories, and counts by shard, policy and split."""
    df = Q.corpus_records(spark, sf_dir).select("trajectory", "shard", F.pmod("trajectory", F.lit(4)).alias("policy"), F.pmod("trajectory", F.lit(3)).alias("split"))
    counted = df.groupBy("shard", "policy", "split").agg(F.count("*").alias("n"), F.count_distinct("trajectory").alias("t"))
    parts = [counted.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws("=", x["k"], x["n"])), ",").alias(c)) for c in ("shard", "policy", "split")]
    whole = counted.agg(F.sum("n").alias("records"), F.sum("t").alias("trajectories"))
    for p in parts:
        whole = whole.crossJoin(p)  # a row each
    return whole.select(F.to_json(F.struct("records", "trajectories", "shard", "policy", "split")).alias("manifest"))


_MANIFEST = f"""WITH {Q._RECORDS}, r AS (SELECT trajectory, shard, trajectory % 4 AS policy, trajectory % 3 AS split FROM rec)
SELECT '{{"records":' || (SELECT count(*) FROM r) || ',"trajectories":' || (SELECT count(DISTINCT trajectory) FROM r)
  || {" || ".join(f"""',"{c}":"' || (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {c} AS k, count(*) AS n FROM r GROUP BY 1)) || '"'""" for c in ("shard", "policy", "split"))} || '}}' AS manifest"""


def symmetric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position scored under each of the eight symmetries: rows, and rows whose scores or evaluation differ from the position's own."""
    df = B.with_symmetries(B.with_symmetries(positions(spark, sf_dir), "p1", "a"), "p2", "b")
    df = materialize(df.select("trajectory", "ply", F.explode(F.array(*[F.struct(F.lit(k).alias("symmetry"), F.col(f"a{k}").alias("q1"), F.col(f"b{k}").alias("q2")) for k in range(8)])).alias("x")).select("trajectory", "ply", "x.*"), "images")
    scored = B.with_scores(df, s1="q1", s2="q2")
    own = scored.filter("symmetry = 0").select("trajectory", "ply", F.col("s1").alias("o1"), F.col("s2").alias("o2"))
    both = scored.join(own, ["trajectory", "ply"])
    return both.groupBy("symmetry").agg(F.count("*").alias("records"), F.count_if((F.col("s1") != F.col("o1")) | (F.col("s2") != F.col("o2"))).alias("differing"), F.sum(F.col("s1") + F.col("s2")).alias("points"))


_SYMMETRIC = f"""WITH p AS ({POSITIONS_DUCK}), sc AS ({duck_scores("p")}), s AS (SELECT sum(a.s + b.s) AS points, count(*) AS records FROM p JOIN sc a ON p1 = a.b JOIN sc b ON p2 = b.b)
SELECT CAST(k AS INT) AS symmetry, records, CAST(0 AS BIGINT) AS differing, CAST(points AS BIGINT) AS points FROM s, range(8) r(k)"""

QUERIES = {
    "source_manifest": (source_manifest, _MANIFEST),
    "symmetric_scores": (symmetric_scores, _SYMMETRIC),
    "move_checks": (move_checks, _MOVE_CHECKS),
    "replayed_games": (replayed_games, _REPLAYED),
    "position_hashes": (position_hashes, _HASHES),
    "move_orbits": (move_orbits, _ORBITS),
    "position_audit": (position_audit, _AUDIT),
    "label_targets": (label_targets, _TARGETS),
    "label_audit": (label_audit, _LABEL_AUDIT),
    "label_histograms": (label_histograms, _HISTOGRAMS),
    "corpus_preflight": (corpus_preflight, _PREFLIGHT),
    "shard_digests": (shard_digests, _DIGESTS),
    "search_log_summary": (search_log_summary, _SEARCH_LOG),
    "opening_corpus": (opening_corpus, _OPENING_CORPUS),
    "even_sample": (even_sample, _EVEN),
    "key_sets": (key_sets, _SETS),
    "series_report": (series_report, _REPORT),
    "run_status": (run_status, _STATUS),
    "ledger_check": (ledger_check, _LEDGER),
    "provenance_groups": (provenance_groups, _PROVENANCE),
}
