"""Views of the driver's tables as the engine's inputs: games, moves, positions and labels.

``moves`` reads events as moves of one trajectory a user; ``positions`` are the boards after
each move; ``games`` reads orders as results; ``label sets`` read line items as two labellings
of one list of records.  The SQL is the same in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MOVES = """
SELECT trajectory, cell, CAST(row_number() OVER (PARTITION BY trajectory ORDER BY ts, event_id) AS INT) AS ply
FROM (SELECT user_id AS trajectory, CAST((event_id * 31 + user_id * 17) % 49 AS INT) AS cell, ts, event_id,
             row_number() OVER (PARTITION BY user_id, (event_id * 31 + user_id * 17) % 49 ORDER BY ts, event_id) AS n
      FROM events) f
WHERE n = 1
"""


def positions_sql(shift: str) -> str:
    """Boards after each move; ``shift`` makes the bit of a cell."""
    return f"""
SELECT trajectory, ply, cell, CAST(ply % 2 AS INT) AS side,
       bit_or(CASE WHEN ply % 2 = 1 THEN {shift} ELSE CAST(0 AS BIGINT) END) OVER w AS p1,
       bit_or(CASE WHEN ply % 2 = 0 THEN {shift} ELSE CAST(0 AS BIGINT) END) OVER w AS p2
FROM ({MOVES}) m
WINDOW w AS (PARTITION BY trajectory ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


POSITIONS_DUCK = positions_sql("(CAST(1 AS BIGINT) << cell)")
POSITIONS_SPARK = positions_sql("shiftleft(1L, cell)")

GAMES = """
SELECT CAST(row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) AS INT) AS game, CAST(o_custkey % 97 AS INT) AS series,
       CASE WHEN o_orderkey % 53 = 0 THEN 'timeout' ELSE 'normal' END AS reason,
       CASE WHEN (o_orderkey * 7 + o_custkey) % 11 = 0 THEN 'none' WHEN (o_orderkey * 5 + o_custkey) % 9 < 5 THEN 'engine_one' ELSE 'engine_two' END AS winner,
       CAST(20 + o_orderkey % 30 AS INT) AS plies, CAST(40 + o_custkey % 50 AS INT) AS score_one, CAST(38 + o_orderkey % 47 AS INT) AS score_two
FROM orders
"""


def labels_sql(which: str) -> str:
    """One of two labellings (a, b) of the same records."""
    k = {"a": 0, "b": 1}[which]
    return f"""
SELECT l_orderkey * 8 + l_linenumber AS ordinal, CAST(l_partkey % 49 AS INT) AS ply, CAST(1 + l_suppkey % 4 AS INT) AS policy,
       CAST((l_partkey * 3 + l_suppkey + {k} * (l_orderkey % 7) * (l_linenumber - 3)) % 81 - 40 AS INT) AS value,
       CAST(1 + (l_partkey + {k} * (l_orderkey % 3)) % 6 AS INT) AS depth, CAST(6 AS INT) AS terminal_depth,
       CAST((l_partkey + {k} * (l_orderkey % 2)) % 49 AS INT) AS best_move, l_orderkey % 5000 + l_linenumber AS nodes
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run SQL over tables of a folder, which are bound as arguments and not as session views."""
    return spark.sql(_braced(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _braced(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(f"{before}{n}\n", f"{before}{{{n}}}\n").replace(f"{before}{n})", f"{before}{{{n}}})").replace(f"{before}{n} ", f"{before}{{{n}}} ")
    return sql


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, POSITIONS_SPARK, "events")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, GAMES + " ", "orders")


def labels(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return run_sql(spark, sf_dir, labels_sql(which) + " ", "lineitem")
