"""Search and games against plain recursion, and generated corpora against their own rules."""

from __future__ import annotations

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from millrace.functions import search as K
from millrace.functions.bitboard import CELLS, FULL
from millrace.operators import play
from millrace.operators.corpus import SOURCE_PHASES
from tests.test_whole_boards import score as slow_score


def board(rng: random.Random, empties: int) -> tuple[int, int]:
    cells = rng.sample(range(CELLS), CELLS - empties)
    return tuple(sum(1 << c for c in cells[k::2]) for k in (0, 1))


def plain(p1: int, p2: int, depth: int, evaluate) -> int:
    if depth == 0 or p1 | p2 == FULL:
        return evaluate(p1, p2)
    return max(-plain(*K.played(p1, p2, c), depth - 1, evaluate) for c in K.empty_cells(p1, p2))


def test_scores_and_gains():
    rng = random.Random(1)
    for _ in range(300):
        p1, p2 = board(rng, rng.randrange(50))
        assert K.score(p1) == slow_score(set(K.cells_of(p1)))
        for c, own, other in K.gains(p1, p2)[:3]:
            sides = (p1, p2) if (p1 | p2).bit_count() % 2 == 0 else (p2, p1)
            assert [own, other] == [slow_score(set(K.cells_of(s | 1 << c))) - slow_score(set(K.cells_of(s))) for s in sides]


def test_search_equals_plain_recursion():
    rng = random.Random(2)
    for empties, depth in ((5, 5), (6, 4), (12, 2), (30, 1), (1, 1), (2, 2)):
        for _ in range(4):
            p1, p2 = board(rng, empties)
            found = list(K.Search("static").iterations(p1, p2, depth))
            assert [x.value for x in found] == [plain(p1, p2, d, K.static_value) for d in range(1, depth + 1)]
            last = found[-1]
            assert last.value == -plain(*K.played(p1, p2, last.best_move), depth - 1, K.static_value) and last.line[0] == last.best_move
    for _ in range(10):  # a closure is a search of two plies
        p1, p2 = board(rng, rng.choice((2, 3, 9)))
        assert K.closure_value(p1, p2) == plain(p1, p2, 2, K.static_value)
        if CELLS - (p1 | p2).bit_count() > 3:
            assert K.Search("closure").run(p1, p2, depth=1)[0].value == plain(p1, p2, 3, K.static_value)


def test_limits_symmetry_and_lines():
    rng = random.Random(3)
    p1, p2 = board(rng, 7)
    deepest, before = K.Search("static").run(p1, p2, nodes=400)
    assert deepest.nodes <= 400 and before.depth + 1 == deepest.depth and deepest.value == plain(p1, p2, deepest.depth, K.static_value)
    assert K.Search().run(0, 0, nodes=1) == (None, None) and K.Search().run(FULL, 0) == (None, None)
    assert len(K.Search().groups(0, 0)) == 10
    *_, (depth, ranked) = K.Search("static").lines(p1, p2, 3, depth=4)
    want = sorted(((-plain(*K.played(p1, p2, c), 3, K.static_value), -c) for c in K.empty_cells(p1, p2)), reverse=True)
    assert depth == 4 and [(x.value, -x.best_move) for x in ranked] == want[:3]


def test_generated_positions(spark):
    got = [play.generate_positions(spark, 12, seed=5, samples=4, nodes=40).repartition(k).collect() for k in (1, 5)]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1])) and len(got[0]) == 48
    for r in got[0]:
        assert r.p1 & r.p2 == 0 and r.p1.bit_count() == (r.ply + 1) // 2 and r.p2.bit_count() == r.ply // 2 and r.policy_id in (1, 2, 3, 4)
        assert any(a <= r.ply <= b for a, b in SOURCE_PHASES)
    games = {}
    for r in sorted(got[0]):
        games.setdefault(r.trajectory_index, []).append(r)
    for rows in games.values():
        assert [r.sample_index for r in rows] == [0, 1, 2, 3] and all(a.ply < b.ply and a.p1 & b.p1 == a.p1 and a.p2 & b.p2 == a.p2 for a, b in pairwise(rows))
        assert len({next(k for k, (a, b) in enumerate(SOURCE_PHASES) if a <= r.ply <= b) for r in rows}) == 4
    with pytest.raises(ValueError):
        play.generate_positions(spark, 1, seed=1, samples=9)


def test_labels_keep_the_parity_of_the_end(spark):
    rng = random.Random(4)
    rows = [(k, *board(rng, e)) for k, e in enumerate((6, 5, 4, 9, 0, 1))]
    got = {r.id: r for r in play.label_positions(spark.createDataFrame(rows, "id int, p1 long, p2 long"), "static", nodes=3000).collect()}
    assert 4 not in got
    for k, p1, p2 in rows:
        if k in got:
            r, empties = got[k], CELLS - (p1 | p2).bit_count()
            assert r.depth % 2 == empties % 2 == r.terminal_depth % 2 and r.value == plain(p1, p2, r.depth, K.static_value) if empties < 7 else r.depth % 2 == empties % 2
            assert r.depth in (r.deepest_depth, r.previous_depth) and r.nodes <= 3000


def test_games_and_analysis(spark):
    rows = [(0, [0, 8], "greedy", "random"), (1, [], "first_legal", "opponent_aware"), (2, [24], "immediate_gain", "greedy")]
    for r in play.play_games(spark.createDataFrame(rows, "game int, opening array<int>, first string, second string")).collect():
        cells = [int(c) for c in r.moves.split()]
        assert sorted(cells) == list(range(CELLS)) and cells[: len(rows[r.game][1])] == rows[r.game][1]
        assert (r.p1, r.p2) == tuple(sum(1 << c for c in cells[k::2]) for k in (0, 1)) and r.score_first == slow_score(set(cells[::2]))
        assert r.winner == (r.first if 2 * r.score_first > 2 * r.score_second + 11 else r.second)
    rng = random.Random(6)
    p1, p2 = board(rng, 5)
    df = spark.createDataFrame([(1, p1, p2, 3, 2)], "request long, p1 long, p2 long, max_depth int, lines int")
    steps = play.analyse(df, progress=True).collect()
    assert sorted({r.depth for r in steps}) == [1, 2, 3] and [r["rank"] for r in sorted(steps)][:2] == [1, 2]
    assert sorted(play.analyse(df).collect()) == [r for r in sorted(steps) if r.depth == 3]
    asked = spark.createDataFrame([(["a1", "b2"], 5, None, 1), (["a1", "A1"], 5, None, 1), (["a1", "h1"], 5, 50, 1), ([], 5, None, 9), (["zz"], 5, 1, 1)], "m array<string>, t int, d int, k int")
    codes = [r.e and (r.e.code, r.e.move_index) for r in asked.select(play.request_error(F.col("m"), F.col("t"), F.col("d"), F.col("k")).alias("e")).collect()]
    assert codes == [None, ("illegal_move", 1), ("invalid_max_depth", None), ("invalid_multi_pv", None), ("malformed_move", 0)]
