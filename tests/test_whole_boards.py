"""Board queries on every position of two full trajectories, against brute force."""

from __future__ import annotations

from collections import defaultdict

import pytest

from millrace.plans import board_queries as Q

CELLS = range(49)


def lines():
    every = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        for r in range(7):
            for c in range(7):
                if not (0 <= r - dr < 7 and 0 <= c - dc < 7):
                    every.append([(r + k * dr) * 7 + c + k * dc for k in range(7) if 0 <= r + k * dr < 7 and 0 <= c + k * dc < 7])
    return every


LINES = lines()


def score(own: set) -> int:
    total, covered = 0, set()
    for line in LINES:
        run = []
        for c in [*line, None]:
            if c in own:
                run.append(c)
                continue
            if len(run) >= 2:
                total += 2 ** (len(run) - 1)
                covered.update(run)
            run = []
    return total + len(own - covered)


def evaluation(p1: set, p2: set, ply: int) -> int:
    margin = (score(p1) - (ply + 1) // 2 + 25) * 2 - ((score(p2) - ply // 2 + 24) * 2 + 11)
    return margin if ply % 2 == 0 else -margin


@pytest.fixture(scope="module")
def boards(spark, tmp_path_factory):
    """The folder of the events of two trajectories of 49 moves, and their positions."""
    path = str(tmp_path_factory.mktemp("boards"))
    rows = [(k + 1, (k * step + step) % 49 + 49 * user, user) for user, step in ((1, 1), (2, 5)) for k in CELLS]
    spark.createDataFrame([(e, u, t) for t, e, u in rows], "event_id long, user_id long, ts long").write.parquet(f"{path}/events.parquet")
    found, sides = {}, defaultdict(lambda: [set(), set()])
    for ts, event, user in rows:
        sides[user][(ts + 1) % 2].add((event * 31 + user * 17) % 49)
        found[user, ts] = tuple(map(frozenset, sides[user]))
    return path, found


@pytest.fixture(scope="module")
def gains(boards):
    """Own and opponent's gain of each empty cell of each position."""
    out = {}
    for (user, ply), sides in boards[1].items():
        own, other = (sides[ply % 2], sides[1 - ply % 2])
        out[user, ply] = {c: (score(own | {c}) - score(own), score(other | {c}) - score(other)) for c in CELLS if c not in own | other}
    return out


def test_gains_of_every_position(spark, boards, gains):
    got = sorted(map(tuple, Q.move_gains(spark, boards[0]).collect()))
    assert got == sorted((*at, c, *g) for at, cells in gains.items() for c, g in cells.items())


def test_closure_of_every_position(spark, boards, gains):
    want = []
    for at, (p1, p2) in boards[1].items():
        base, cells = evaluation(p1, p2, at[1]), gains[at]
        best = [2 * (cells[c][0] - max(cells[d][1] for d in cells if d != c)) if len(cells) > 1 else 2 * (cells[c][0] - 1) for c in cells]
        want.append((*at, base, base + max(best, default=0)))
    assert sorted(map(tuple, Q.closure(spark, boards[0]).collect())) == sorted(want)


def test_summaries_of_every_position(spark, boards, gains):
    want = []
    for at, cells in gains.items():
        if not cells:
            continue
        own, other = ([g[k] for g in cells.values()] for k in (0, 1))
        tops = [(sorted(x, reverse=True) + [0] * 4)[:4] for x in (own, other)]
        unique = other.count(tops[1][0]) == 1
        reply = [tops[1][1] if unique and y == tops[1][0] else tops[1][0] for y in other]
        best = max(x - r for x, r in zip(own, reply))
        counts = [sum(x >= t for x in side) for side in (own, other) for t in (2, 4, 8, 16)]
        want.append((*at, *tops[0], *tops[1], *counts, int((tops[0][0], tops[1][0]) in zip(own, other)), int(unique), min(tops[1][0] - r for x, r in zip(own, reply) if x - r == best)))
    assert sorted(map(tuple, Q.gain_summaries(spark, boards[0]).collect())) == sorted(want)


def test_policies_on_every_position(spark, boards, gains):
    want = [(*at, min(cells), min(cells, key=lambda c: (-cells[c][0], c)), max(g[0] for g in cells.values())) for at, cells in gains.items() if cells]
    assert sorted(map(tuple, Q.greedy_moves(spark, boards[0]).collect())) == sorted(want)


def test_successors_of_every_position(spark, boards):
    turns = [lambda r, c: (r, c), lambda r, c: (c, 6 - r), lambda r, c: (6 - r, 6 - c), lambda r, c: (6 - c, r)]
    maps = [[t(c // 7, k)[0] * 7 + t(c // 7, k)[1] for c in CELLS for k in ((6 - c % 7) if flip else c % 7,)] for t in turns for flip in (False, True)]
    want = []
    for (user, ply), sides in boards[1].items():
        groups = defaultdict(list)
        for c in sorted(set(CELLS) - sides[0] - sides[1]):
            after = [s | {c} if k == ply % 2 else s for k, s in enumerate(sides)]
            groups[min(tuple(tuple(sorted(m[x] for x in s)) for s in after) for m in maps)].append(c)
        want += [(user, ply, x[0], len(x)) for x in groups.values()]
    assert sorted(map(tuple, Q.successor_groups(spark, boards[0]).collect())) == sorted(want)
