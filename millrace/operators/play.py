"""Games and positions made by policies, searches over tables of positions, and analyses of requests.

Each row is handled on its own inside a task, with a generator seeded by the row, so neither the
partitions nor their order change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from millrace.functions import search as K
from millrace.functions.bitboard import CELLS, parse_move
from millrace.operators.corpus import SOURCE_PHASES

#: Salts of ids, the generator's step, the numbers of policies.
GAMMA, FAMILY_SALT, TRAJECTORY_SALT = 0x9E3779B97F4A7C15, 0x4E8B2D7D34A2C1F9, 0xD1B54A32D192ED03
POLICIES = {"random": 1, "immediate_gain": 2, "opponent_aware": 3, "noisy_search": 4}
_TOP = (1 << 64) - 1


def mix(x: int) -> int:
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _TOP
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _TOP
    return x ^ x >> 31


class Rng:
    """SplitMix64 with unbiased bounded numbers."""

    def __init__(self, seed: int):
        self.state = seed & _TOP

    def next(self) -> int:
        self.state = (self.state + GAMMA) & _TOP
        return mix(self.state)

    def below(self, bound: int) -> int:
        least = (1 << 64) % bound
        while (x := self.next()) < least:
            pass
        return x % bound

    def shuffled(self, items: list) -> list:
        """Fisher-Yates from the end."""
        out = list(items)
        for n in range(len(out), 1, -1):
            k = self.below(n)
            out[k], out[n - 1] = out[n - 1], out[k]
        return out


def _best(cells: list[tuple[int, int]], rng: Rng | None) -> int:
    """A cell of the largest value: the generator's choice among ties, the first without one."""
    top = max(v for _, v in cells)
    ties = [c for c, v in cells if v == top]
    return ties[rng.below(len(ties))] if rng else ties[0]


def _aware(p1: int, p2: int, rng: Rng | None) -> int:
    found = K.gains(p1, p2)
    replies = sorted(((r, -c) for c, _, r in found), reverse=True)
    first = -replies[0][1]
    second = replies[1][0] if len(replies) > 1 else 0
    return _best([(c, own - (second if c == first else replies[0][0])) for c, own, _ in found], rng)


def _random(p1: int, p2: int, rng: Rng) -> int:
    cells = K.empty_cells(p1, p2)
    return cells[rng.below(len(cells))]


#: Policies of one move: (boards, generator, search) to a cell.
MOVES: dict[str, Callable[[int, int, Rng, K.Search], int]] = {
    "first_legal": lambda p1, p2, rng, s: K.empty_cells(p1, p2)[0],
    "greedy": lambda p1, p2, rng, s: _best([(c, own) for c, own, _ in K.gains(p1, p2)], None),
    "random": lambda p1, p2, rng, s: _random(p1, p2, rng),
    "immediate_gain": lambda p1, p2, rng, s: _best([(c, own) for c, own, _ in K.gains(p1, p2)], rng),
    "opponent_aware": lambda p1, p2, rng, s: _aware(p1, p2, rng),
}


def searched_move(p1: int, p2: int, rng: Rng, search: K.Search, nodes: int, noise: int = 0) -> int:
    """The move of a search of so many positions; a random one in ``noise`` percent, or if no depth is completed."""
    if noise and rng.below(100) < noise:
        return _random(p1, p2, rng)
    deepest = search.run(p1, p2, nodes=nodes)[0]
    return deepest.best_move if deepest else _random(p1, p2, rng)


def target_plies(index: int, samples: int, rng: Rng) -> list[int]:
    """Plies of a trajectory's samples: one a phase of shuffled phases, of a parity by index and phase."""
    out = []
    for phase in rng.shuffled(list(range(len(SOURCE_PHASES))))[:samples]:
        a, b = SOURCE_PHASES[phase]
        first = a + ((a & 1) != (index + phase & 1))
        out.append(first + 2 * rng.below((b - first) // 2 + 1))
    return sorted(out)


_SAMPLES = "trajectory_index long, family_id long, trajectory_id long, policy_id int, sample_index int, ply int, p1 long, p2 long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def trajectory(index: int, seed: int, samples: int, weights: dict[str, int], nodes: int, noise: int) -> list[tuple]:
    """Samples of one game played by a policy that its generator draws."""
    rng = Rng(mix(seed ^ mix((index + GAMMA) & _TOP)))
    at, policy = rng.below(sum(weights.values())), ""
    for name in POLICIES:
        policy = name
        if at < weights.get(name, 0):
            break
        at -= weights.get(name, 0)
    targets = target_plies(index, samples, rng)
    family, own = (mix(seed ^ mix(index ^ salt)) or 1 for salt in (FAMILY_SALT, TRAJECTORY_SALT))
    engine = K.Search("closure")
    p1 = p2 = 0
    out = []
    while len(out) < samples:
        cell = searched_move(p1, p2, rng, engine, nodes, noise) if policy == "noisy_search" else MOVES[policy](p1, p2, rng, engine)
        p1, p2 = K.played(p1, p2, cell)
        if (p1 | p2).bit_count() == targets[len(out)]:
            out.append((index, _signed(family), _signed(own), POLICIES[policy], len(out), targets[len(out)], p1, p2))
    return out


def _arrow(schema: str) -> pa.Schema:
    """Arrow's form of a schema (asked for in the driver, since it needs the session)."""
    return to_arrow_schema(_parse_datatype_string(schema))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def generate_positions(spark: SparkSession, trajectories: int, seed: int, samples: int = 8, weights: dict[str, int] | None = None, nodes: int = 200, noise: int = 10) -> DataFrame:
    """Sampled positions of so many games; each game depends on its index and the seed alone."""
    if not 1 <= samples <= len(SOURCE_PHASES):
        raise ValueError("a trajectory has one to eight samples")
    mixed = weights or {"random": 25, "immediate_gain": 25, "opponent_aware": 25, "noisy_search": 25}

    arrow = _arrow(_SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield _rows(arrow, trajectory(k, seed, samples, mixed, nodes, noise))

    return spark.range(trajectories).mapInArrow(run, _SAMPLES)


_LABELS = "value int, best_move int, depth int, nodes long, deepest_value int, deepest_depth int, deepest_best_move int, previous_value int, previous_depth int, terminal_depth int, attempted_depth int"


def label_positions(df: DataFrame, evaluator: str = "closure", depth: int | None = None, nodes: int | None = None, exact: bool = False) -> DataFrame:
    """Add a search's label to rows with p1 and p2; rows without one (full boards, limits too low, no depth of the right parity) are left out.

    The target is the deepest completed depth if it has the parity of the terminal depth, else the
    one before.  ``exact`` wants the terminal depth itself.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = [df.columns.index(c) for c in ("p1", "p2")]

    def label(engine: K.Search, p1: int, p2: int) -> tuple | None:
        engine.new_game()
        last = K.terminal_depth(CELLS - (p1 | p2).bit_count(), engine.ahead)
        deepest, before = engine.run(p1, p2, last if exact else depth, nodes)
        if deepest is None or exact and deepest.depth != last:
            return None
        target = deepest if deepest.depth % 2 == last % 2 else before
        if target is None:
            return None
        return (target.value, target.best_move, target.depth, target.nodes, deepest.value, deepest.depth, deepest.best_move, before.value if before else None, before.depth if before else None, last, min(deepest.depth + 1, last))

    schema = f"{kept}, {_LABELS}"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = K.Search(evaluator)
        for b in batches:
            rows = [(r, label(engine, r[at[0]], r[at[1]])) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield _rows(arrow, [(*r, *x) for r, x in rows if x])

    return df.mapInArrow(run, schema)


_GAMES = "game int, opening string, first string, second string, moves string, p1 long, p2 long, score_first int, score_second int, winner string, plies int"


def play_games(df: DataFrame, nodes: int = 200) -> DataFrame:
    """Play rows (game, opening as cells, first, second: names of policies, or ``search``) to the end; a seed is the game's number."""

    def game(number: int, opening: list[int], players: tuple[str, str]) -> tuple:
        rng, engines = Rng(number), [K.Search("closure"), K.Search("closure")]
        p1 = p2 = 0
        moves = []
        for ply in range(CELLS):
            name = players[ply % 2]
            if ply < len(opening):
                cell = opening[ply]
            elif name == "search":
                cell = searched_move(p1, p2, rng, engines[ply % 2], nodes)
            else:
                cell = MOVES[name](p1, p2, rng, engines[ply % 2])
            if (p1 | p2) >> cell & 1:
                raise ValueError(f"game {number}: cell {cell} is taken")
            moves.append(cell)
            p1, p2 = K.played(p1, p2, cell)
        a, b = K.score(p1), K.score(p2)
        return (number, " ".join(map(str, opening)), *players, " ".join(map(str, moves)), p1, p2, a, b, players[0] if 2 * a > 2 * b + 11 else players[1], len(moves))

    arrow = _arrow(_GAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(arrow, [game(n, list(o), (x, y)) for n, o, x, y in zip(*(c.to_pylist() for c in b.columns))])

    return df.select(F.col("game").cast("int"), "opening", "first", "second").mapInArrow(run, _GAMES)


def request_error(moves: Column, time_ms: Column, depth: Column, lines: Column) -> Column:
    """Null for a request that can be analysed, else struct<code, field, move_index, move, reason>, the first that applies.

    The moves are text; the first that is malformed, repeats a cell or follows the end is told.
    """
    cells = F.transform(moves, parse_move)
    bad = F.transform(cells, lambda c, i: F.when(c.isNull(), "malformed").when(F.array_contains(F.slice(cells, 1, i), c), "occupied"))
    at = F.array_position(F.transform(bad, lambda x: x.isNotNull()), True) - 1

    def error(code: str, name: str, index: Column = F.lit(None), move: Column = F.lit(None), reason: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), index.cast("int").alias("move_index"), move.cast("string").alias("move"), reason.cast("string").alias("reason"))

    wrong = F.get(bad, at.cast("int"))
    return (
        F.when(F.size(moves) > CELLS, error("invalid_history", "moves")).when(time_ms.isNull() | (time_ms <= 0), error("invalid_search_time", "searchTimeMs")).when(depth.isNotNull() & ~depth.between(1, CELLS), error("invalid_max_depth", "maxDepth"))
        .when(lines.isNull() | ~lines.between(1, 5), error("invalid_multi_pv", "multiPv")).when((at >= 0) & (wrong == "malformed"), error("malformed_move", "moves", at, F.get(moves, at.cast("int")), wrong))
        .when(at >= 0, error("illegal_move", "moves", at, F.get(moves, at.cast("int")), wrong)).when(F.size(moves) == CELLS, error("terminal_position", "moves"))
    )


_LINES = "request long, depth int, rank int, move string, value_p1 int, line string, equivalents string, nodes long"


def _text(cell: int) -> str:
    return f"{'abcdefg'[cell % 7]}{cell // 7 + 1}"


def analyse(df: DataFrame, nodes: int = 2000, progress: bool = False) -> DataFrame:
    """The best lines of rows (request, p1, p2, max_depth, lines): a row a line of the deepest completed depth, or of each with ``progress``.

    Values are for player one; moves that a symmetry makes equal to a line's first are told beside it.
    """

    def found(request: int, p1: int, p2: int, depth: int | None, count: int) -> list[tuple]:
        side = 1 if (p1 | p2).bit_count() % 2 == 0 else -1
        out: list[tuple] = []
        for d, ranked in K.Search("closure").lines(p1, p2, count, depth, nodes):
            rows = [(request, d, k + 1, _text(x.best_move), side * x.value, " ".join(map(_text, x.line)), " ".join(_text(c) for c in x.roots[0][2]), x.nodes) for k, x in enumerate(ranked)]
            out = [*out, *rows] if progress else rows
        return out

    arrow = _arrow(_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                yield _rows(arrow, found(*r))

    return df.select("request", "p1", "p2", "max_depth", "lines").mapInArrow(run, _LINES)
