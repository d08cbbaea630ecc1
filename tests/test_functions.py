"""Bitboards by plain loops, match statistics by published values, files by round trips."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import bitboard as B
from millrace.functions import inference, u64
from millrace.sources import boards

#: Published results of paired matches: counts, bounds in percent, likelihood ratio and normalized Elo (if known).
LEDGER = [
    ((2, 0, 36, 0, 12), 49.209, 71.411, None, None), ((0, 0, 116, 0, 4), 48.985, 55.414, None, None), ((5, 0, 56, 0, 18), 49.231, 67.648, None, None), ((2, 0, 28, 0, 0), 35.677, 56.045, None, None),
    ((3, 0, 31, 0, 14), 48.921, 73.936, None, None), ((3, 0, 40, 0, 1), 38.664, 55.953, None, None), ((6, 0, 85, 0, 20), 49.462, 63.695, None, None), ((16, 0, 193, 0, 37), 49.701, 59.108, None, None),
    ((34, 0, 510, 0, 58), 49.448, 54.649, 3.030, 25.185), ((0, 0, 7, 0, 35), 78.889, 98.191, 2.985, 549.062), ((10, 0, 365, 0, 26), 49.717, 54.552, 3.083, 33.009),
]


def score(board: int) -> int:
    total, covered = 0, set()
    for line in B.scoring_lines():
        run: list[int] = []
        for c in [*line, None]:
            if c is not None and board >> c & 1:
                run.append(c)
                continue
            if len(run) >= 2:
                total += 2 ** (len(run) - 1)
                covered |= set(run)
            run = []
    return total + bin(board).count("1") - len(covered)


def test_scores_and_symmetries(spark):
    rng = random.Random(1)
    rows = [(x, y & ~x) for x, y in ((rng.getrandbits(49), rng.getrandbits(49)) for _ in range(300))] + [(0, 0), (B.FULL, 0), (1, 1 << 48)]
    df = spark.createDataFrame(rows, "p1 long, p2 long").withColumn("side", F.lit(0))
    out = B.with_canonical(B.with_scores(df, s="p1")).collect()
    for r in out:
        assert r.s == score(r.p1)

        def image(b, k):
            return sum(1 << B.transform_cell(k, c) for c in range(49) if b >> c & 1)

        keys = [(image(r.p1, k), image(r.p2, k)) for k in range(8)]
        assert (r.canonical_low, r.canonical_high) == min(keys) and r.symmetry == keys.index(min(keys))


def test_lines_and_orbits():
    sizes = [len(x) for x in B.scoring_lines()]
    assert sizes.count(7) == 16 and all(sizes.count(k) == 4 for k in range(2, 7))
    orbits = B.reversal_orbits()
    assert len(orbits) == 3276 and max(orbits) + 1 == 1716


def test_unsigned_arithmetic(spark):
    rng = random.Random(2)
    xs = [rng.getrandbits(64) for _ in range(100)] + [0, 1, (1 << 64) - 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in xs]
    df = spark.createDataFrame([(x,) for x in signed], "x long")
    got = u64.with_mix64(df, "x", "h").select("x", "h", u64.modulo(F.col("x"), 100).alias("r")).collect()
    for r in got:
        z = r.x % (1 << 64)
        assert r.r == z % 100
        z = (z ^ z >> 30) * u64.MIX_ONE % (1 << 64)
        z = (z ^ z >> 27) * u64.MIX_TWO % (1 << 64)
        assert r.h % (1 << 64) == z ^ z >> 31


def test_published_statistics():
    counts = np.array([x[0] for x in LEDGER], float)
    low, high = inference.confidence(counts)
    assert np.allclose(low * 100, [x[1] for x in LEDGER], atol=6e-4) and np.allclose(high * 100, [x[2] for x in LEDGER], atol=6e-4)
    known = [k for k, x in enumerate(LEDGER) if x[3] is not None]
    assert np.allclose(inference.log_likelihood_ratio(counts)[known], [LEDGER[k][3] for k in known], atol=6e-4)
    assert np.allclose(inference.normalized_elo(counts)[known], [LEDGER[k][4] for k in known], atol=6e-4)
    one = np.array([[3, 0, 20, 0, 7]], float)
    assert np.isclose(inference.log_likelihood_ratio(one)[0], 0.4673233262) and np.isclose(inference.normalized_elo(one)[0], 58.30870036)
    assert np.allclose(inference.wald_bounds(), (-2.944438979, 2.944438979))


def test_position_files(spark, tmp_path):
    rows = [(1 << k, 1 << k + 1, k + 1, -5, k + 7, 0, k, 1 + k % 4, 0, 1 + k % 3, 2) for k in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{x.split()[0]} {'bigint' if x.split()[0] in boards.HEX_COLUMNS else x.split()[1]}" for x in boards.POSITION_SCHEMA.split(", ")))
    boards.write_positions(df, f"{tmp_path}/p", 3)
    lines = spark.read.text(f"{tmp_path}/p")
    assert [r["count"] for r in lines.groupBy("shard").count().orderBy("shard").collect()] == [4, 3, 3]
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "positions-00001.jsonl").write_text('{"type":"header"}\n' + "\n".join(r.value for r in lines.collect()) + '\n{"p1":"zz"}\n')
    back = boards.read_positions(spark, str(flat), shard=1)
    assert {(r.p1, r.p2, r.family_id) for r in back.filter("p1 IS NOT NULL").collect()} == {(r[0], r[1], -5) for r in rows}
    assert {r.rule for r in boards.violations(back).collect()} == {"malformed"}
    assert {r.rule for r in boards.violations(df.withColumn("p2", F.col("p1"))).collect()} == {"overlap"}


def test_label_files(spark, tmp_path):
    dtype = np.dtype({"names": [n for n, _ in boards.LABEL_FIELDS], "formats": [t for _, t in boards.LABEL_FIELDS], "offsets": [np.dtype(boards.LABEL_FIELDS).fields[n][1] for n, _ in boards.LABEL_FIELDS], "itemsize": 140})
    rows = np.zeros(3, dtype)
    rows["player_one"], rows["value"], rows["source_id"] = [5, 6, 7], [-7, 0, 9], [1 << 63, 1, 2]
    (tmp_path / "x.bin").write_bytes(b"\0" * boards.LABEL_HEADER + rows.tobytes())
    got = boards.read_labels(spark, str(tmp_path / "x.bin"), 140).orderBy("place").collect()
    assert [(r.player_one, r.value) for r in got] == [(5, -7), (6, 0), (7, 9)] and got[0].source_id == -(1 << 63)


def test_books_ledgers_and_events(spark, tmp_path):
    (tmp_path / "book.txt").write_text("# a book\n\nstartpos\nD4 e5 # two\na1 a1\nz9\n")
    got = {r.line_number: (r.cells, r.valid) for r in boards.read_openings(spark, str(tmp_path / "book.txt")).collect()}
    assert got[3] == ([], True) and got[4] == ([24, 32], True) and not got[5][1] and not got[6][1]
    (tmp_path / "a.csv").write_text("run_id,kind\nr1,match\n")
    (tmp_path / "b.csv").write_text('run_id,kind,note\nr2,series,"x ""y"", z"\nr3,,\n')
    ledger = boards.read_ledger(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert {(r.run_id, r.note) for r in ledger.collect()} == {("r1", None), ("r2", 'x "y", z'), ("r3", None)}
    assert [r.run_id for r in boards.append_to_ledger(ledger, spark.createDataFrame([("r1", "m"), ("r9", "m")], "run_id string, kind string")).collect()] == ["r9"]
    events = spark.createDataFrame([(1,), (2,), (4,)], "sequence long")
    assert [r.sequence for r in boards.event_gaps(events).collect()] == [4]
    assert spark.range(1).select(boards.pairs_of_line(F.lit("a=1  b=x")).alias("m")).first().m == {"a": "1", "b": "x"}
