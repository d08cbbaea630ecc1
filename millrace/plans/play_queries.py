"""Searches, games and analyses as queries: endings by exact search, games of policies, generated corpora, analysed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import bitboard as B
from millrace.operators import play
from millrace.plans.adapters import POSITIONS_DUCK, positions
from millrace.plans.board_queries import duck_scores

#: Empty cells of an ending.
LEFT = 4


def endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trajectory's last position, filled up in order of the cells, by turns, until LEFT are empty."""
    last = positions(spark, sf_dir).groupBy("trajectory").agg(F.max_by(F.struct("ply", "p1", "p2"), "ply").alias("x")).select("trajectory", "x.*")
    free = B.explode_empty(last, F.col("p1").bitwiseOR(F.col("p2"))).withColumn("i", F.row_number().over(Window.partitionBy("trajectory").orderBy("cell")) - 1)
    side = (F.col("i") + F.col("ply")) % 2
    added = free.filter(F.col("i") < B.CELLS - F.col("ply") - LEFT).groupBy("trajectory").agg(*[F.bit_or(F.when(side == k, B.bit(F.col("cell"))).otherwise(B.lit(0))).alias(f"a{k}") for k in (0, 1)])
    both = last.join(added, "trajectory", "left")
    return both.select("trajectory", *[F.col(f"p{k + 1}").bitwiseOR(F.coalesce(f"a{k}", B.lit(0))).alias(f"p{k + 1}") for k in (0, 1)])


_ENDINGS = f"""p AS ({POSITIONS_DUCK}), la AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY trajectory ORDER BY ply DESC) = 1),
 fr AS (SELECT trajectory, ply, p1, p2, c, row_number() OVER (PARTITION BY trajectory ORDER BY c) - 1 AS i FROM la, range(49) r(c) WHERE ((p1 | p2) >> c) & 1 = 0),
 en AS (SELECT la.trajectory, la.p1 | coalesce(bit_or(CASE WHEN (i + la.ply) % 2 = 0 AND i < 49 - la.ply - {LEFT} THEN CAST(1 AS BIGINT) << c END), 0) AS p1, la.p2 | coalesce(bit_or(CASE WHEN (i + la.ply) % 2 = 1 AND i < 49 - la.ply - {LEFT} THEN CAST(1 AS BIGINT) << c END), 0) AS p2 FROM la LEFT JOIN fr USING (trajectory) GROUP BY la.trajectory, la.p1, la.p2)"""


def ending_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact values of the endings by search, for the side to move, with the depth that sees the end."""
    found = play.label_positions(endings(spark, sf_dir), "static", exact=True)
    return found.select("trajectory", "p1", "p2", "value", "depth", "terminal_depth")


def _solved() -> str:
    """Every order of the last LEFT cells, and the best choices from the last move to the first."""
    ctes = ["l0 AS (SELECT trajectory, p1, p2, CAST([] AS INT[]) AS path FROM en)"]
    for k in range(LEFT):
        side = f"(bit_count(p1 | p2) % 2 = {0})"
        ctes.append(f"l{k + 1} AS (SELECT trajectory, CASE WHEN {side} THEN p1 | (CAST(1 AS BIGINT) << c) ELSE p1 END AS p1, CASE WHEN {side} THEN p2 ELSE p2 | (CAST(1 AS BIGINT) << c) END AS p2, list_append(path, CAST(c AS INT)) AS path FROM l{k}, range(49) r(c) WHERE ((p1 | p2) >> c) & 1 = 0)")
    ctes.append(f"sc AS ({duck_scores(f'l{LEFT}')})")
    ctes.append(f"v{LEFT} AS (SELECT trajectory, path, 2 * a.s - (2 * b.s + 11) AS m FROM l{LEFT} JOIN sc a ON p1 = a.b JOIN sc b ON p2 = b.b)")
    for k in reversed(range(LEFT)):
        pick = "max" if (49 - LEFT + k) % 2 == 0 else "min"
        ctes.append(f"v{k} AS (SELECT trajectory, path[1:{k}] AS path, {pick}(m) AS m FROM v{k + 1} GROUP BY 1, 2)")
    return ", ".join(ctes)


_ENDING_LABELS = f"""WITH {_ENDINGS}, {_solved()}
SELECT trajectory, p1, p2, CAST(CASE WHEN (49 - {LEFT}) % 2 = 0 THEN m ELSE -m END AS INT) AS value, {LEFT} AS depth, {LEFT} AS terminal_depth FROM v0 JOIN en USING (trajectory)"""


def policy_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games between policies from every trajectory's first two moves: two a pair, sides changed."""
    firsts = positions(spark, sf_dir).filter("ply <= 2").groupBy("trajectory").agg(F.transform(F.sort_array(F.collect_list(F.struct("ply", "cell"))), lambda x: x["cell"]).alias("opening"))
    turns = firsts.select("trajectory", "opening", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    a, b = F.lit("greedy"), F.lit("opponent_aware")
    game = (F.col("trajectory") * 2 + F.col("turn")).cast("int")
    return play.play_games(turns.select(game.alias("game"), "opening", F.when(F.col("turn") == 0, a).otherwise(b).alias("first"), F.when(F.col("turn") == 0, b).otherwise(a).alias("second")))


def generated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of sampled positions of sixty-four generated games, whatever the tables."""
    return play.generate_positions(spark, 64, seed=20260818, nodes=60)


def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of every trajectory's moves, some of them wrong by rule: what is wrong with each, if anything."""
    df = positions(spark, sf_dir).groupBy("trajectory").agg(F.transform(F.sort_array(F.collect_list(F.struct("ply", "cell"))), lambda x: B.format_move(x["cell"])).alias("moves"))
    t = F.col("trajectory")
    moves = F.when(t % 7 == 1, F.concat("moves", F.array(F.lit("h9")))).when(t % 7 == 2, F.concat("moves", F.slice("moves", 1, 1))).otherwise(F.col("moves"))
    error = play.request_error(F.col("m"), F.when(t % 11 == 3, -1).otherwise(100), F.when(t % 13 == 4, 50).otherwise(F.lit(None)), (t % 7 + 1).cast("int"))
    return df.select("trajectory", moves.alias("m")).select("trajectory", error.alias("e")).select("trajectory", "e.code", "e.field", "e.move_index", "e.move", "e.reason")


_REQUESTS = f"""WITH p AS ({POSITIONS_DUCK}), m AS (SELECT trajectory, count(*) AS n, arg_min(cell, ply) AS c FROM p GROUP BY 1),
 x AS (SELECT trajectory, n, chr(CAST(97 + c % 7 AS INT)) || CAST(c // 7 + 1 AS VARCHAR) AS first, CASE WHEN n + CASE WHEN trajectory % 7 IN (1, 2) THEN 1 ELSE 0 END > 49 THEN 'invalid_history' WHEN trajectory % 11 = 3 THEN 'invalid_search_time' WHEN trajectory % 13 = 4 THEN 'invalid_max_depth'
   WHEN trajectory % 7 + 1 > 5 THEN 'invalid_multi_pv' WHEN trajectory % 7 = 1 THEN 'malformed_move' WHEN trajectory % 7 = 2 THEN 'illegal_move' WHEN n = 49 THEN 'terminal_position' END AS code FROM m)
SELECT trajectory, code, CASE code WHEN 'invalid_search_time' THEN 'searchTimeMs' WHEN 'invalid_max_depth' THEN 'maxDepth' WHEN 'invalid_multi_pv' THEN 'multiPv' WHEN NULL THEN NULL ELSE CASE WHEN code IS NOT NULL THEN 'moves' END END AS field,
  CAST(CASE WHEN code IN ('malformed_move', 'illegal_move') THEN n END AS INT) AS move_index, CASE code WHEN 'malformed_move' THEN 'h9' WHEN 'illegal_move' THEN first END AS move, CASE code WHEN 'malformed_move' THEN 'malformed' WHEN 'illegal_move' THEN 'occupied' END AS reason FROM x"""


def ending_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best lines of every ending."""
    df = endings(spark, sf_dir).select(F.col("trajectory").alias("request"), "p1", "p2", F.lit(None).cast("int").alias("max_depth"), F.lit(3).alias("lines"))
    return play.analyse(df)


QUERIES = {
    "ending_labels": (ending_labels, _ENDING_LABELS),
    "policy_games": (policy_games, None),
    "generated_positions": (generated_positions, None),
    "request_errors": (request_errors, _REQUESTS),
    "ending_analysis": (ending_analysis, None),
}
