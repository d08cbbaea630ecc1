"""Bitboards of a 7x7 board as native column expressions.

A board is a BIGINT whose bit row * 7 + column is set where a piece stands.  Everything here is
bit arithmetic on columns, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, CELLS = 7, 49
FULL = (1 << CELLS) - 1
#: Step of a direction and the cells from which a step stays on the board.
DIRECTIONS = {
    "across": (1, lambda r, c: c < 6),
    "down": (7, lambda r, c: r < 6),
    "right": (8, lambda r, c: r < 6 and c < 6),
    "left": (6, lambda r, c: r < 6 and c > 0),
}
#: Coefficients of the numbers of windows of k pieces in the score.
WINDOWS = {2: 2, 4: 2, 5: 4, 6: 8, 7: 16}
SYMMETRIES = ("identity", "rotate90", "rotate180", "rotate270", "reflect_horizontal", "reflect_vertical", "reflect_main_diagonal", "reflect_anti_diagonal")


def lit(x: int) -> Column:
    return F.lit(x).cast("long")


def mask(keep) -> int:
    """Bits of the cells (row, column) that are kept."""
    return sum(1 << (r * SIZE + c) for r in range(SIZE) for c in range(SIZE) if keep(r, c))


def bit(cell: Column) -> Column:
    return F.call_function("shiftleft", lit(1), cell.cast("int"))


def has(board: Column, cell: Column) -> Column:
    return F.call_function("shiftright", board, cell.cast("int")).bitwiseAND(lit(1)) == 1


def _right(x: Column, n: int) -> Column:
    return F.shiftright(x, n) if n else x


def _left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n) if n else x


def with_scores(df: DataFrame, **boards: str) -> DataFrame:
    """Add a score column for each board column: name=board.

    A maximal run of L >= 2 pieces counts 2^(L-1); a piece in no run counts 1.  By windows: a run
    of L has L - k + 1 windows of k, and the coefficients of WINDOWS turn their numbers into
    powers of two, so no run has to be found.
    """
    pairs, out = {}, {}
    for name, board in boards.items():
        b = F.col(board)
        for d, (step, inside) in DIRECTIONS.items():
            pairs[f"__{name}_{d}"] = b.bitwiseAND(_right(b, step)).bitwiseAND(lit(mask(inside)))
    staged = df.withColumns(pairs)
    for name, board in boards.items():
        parts, runs = [], []
        for d, (step, _) in DIRECTIONS.items():
            w2 = F.col(f"__{name}_{d}")
            for k, weight in WINDOWS.items():
                window = reduce(lambda x, y: x.bitwiseAND(y), [_right(w2, step * j) for j in range(k - 1)])
                parts.append(F.bit_count(window) * weight)
            runs += [w2, _left(w2, step)]
        inside = reduce(lambda x, y: x.bitwiseOR(y), runs)
        single = F.bit_count(F.col(board).bitwiseAND(F.bitwise_not(inside)))
        out[name] = (reduce(lambda x, y: x + y, parts) + single).cast("int")
    return staged.withColumns(out).drop(*pairs)


def flip_rows(b: Column) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), [_left(_right(b, SIZE * r).bitwiseAND(lit(127)), SIZE * (6 - r)) for r in range(SIZE)])


def flip_columns(b: Column) -> Column:
    first = mask(lambda r, c: c == 0)
    return reduce(lambda x, y: x.bitwiseOR(y), [_left(_right(b, c).bitwiseAND(lit(first)), 6 - c) for c in range(SIZE)])


def transpose(b: Column) -> Column:
    """Cells of one diagonal move by the same distance."""
    parts = []
    for d in range(-6, 7):  # row - column
        x = b.bitwiseAND(lit(mask(lambda r, c, d=d: r - c == d)))
        parts.append(_right(x, 6 * d) if d >= 0 else _left(x, -6 * d))
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def with_symmetries(df: DataFrame, board: str, prefix: str) -> DataFrame:
    """Add prefix0 .. prefix7: the board under every symmetry."""
    b = F.col(board)
    staged = df.withColumns({f"{prefix}0": b, f"{prefix}6": transpose(b), f"{prefix}4": flip_rows(b)})
    staged = staged.withColumns({f"{prefix}5": flip_columns(b), f"{prefix}2": flip_columns(F.col(f"{prefix}4"))})
    return staged.withColumns({f"{prefix}1": flip_columns(F.col(f"{prefix}6")), f"{prefix}3": flip_rows(F.col(f"{prefix}6")), f"{prefix}7": flip_rows(flip_columns(F.col(f"{prefix}6")))})


def position_key(p1: Column, p2: Column, side: Column) -> Column:
    """Exact key: player one's board; player two's with the side to move above it."""
    return F.struct(p1.alias("low"), p2.bitwiseOR(F.shiftleft(side.cast("long"), CELLS)).alias("high"))


def with_canonical(df: DataFrame, p1: str = "p1", p2: str = "p2", side: str = "side") -> DataFrame:
    """Add canonical_low, canonical_high, symmetry (the first that gives the least key) and stabilizer (bits of symmetries that leave the board as it is)."""
    staged = with_symmetries(with_symmetries(df, p1, "__a"), p2, "__b")
    high = F.shiftleft(F.col(side).cast("long"), CELLS)
    keys = F.array(*[F.struct(F.col(f"__a{k}").alias("low"), F.col(f"__b{k}").bitwiseOR(high).alias("high"), F.lit(k).alias("symmetry")) for k in range(8)])
    same = reduce(lambda x, y: x + y, [F.when((F.col(f"__a{k}") == F.col("__a0")) & (F.col(f"__b{k}") == F.col("__b0")), 1 << k).otherwise(0) for k in range(8)])
    staged = staged.withColumns({"__least": F.array_min(keys), "stabilizer": same.cast("int")})
    out = staged.withColumns({"canonical_low": F.col("__least.low"), "canonical_high": F.col("__least.high"), "symmetry": F.col("__least.symmetry")})
    return out.drop("__least", *[f"__{x}{k}" for x in "ab" for k in range(8)])


def transform_cell(k: int, cell: int) -> int:
    """The cell that a cell moves to under symmetry k."""
    r, c = divmod(cell, SIZE)
    r, c = [(r, c), (c, 6 - r), (6 - r, 6 - c), (6 - c, r), (6 - r, c), (r, 6 - c), (c, r), (6 - c, 6 - r)][k]
    return r * SIZE + c


def inverse_symmetry(k: int) -> int:
    return {1: 3, 3: 1}.get(k, k)


def static_evaluation(s1: Column, s2: Column, ply: Column) -> Column:
    """Half-point margin for the side to move, each score measured against its share of the plies."""
    one = (s1 - F.ceil(ply / 2) + 25) * 2
    two = (s2 - F.floor(ply / 2) + 24) * 2 + 11
    return F.when(F.pmod(ply, F.lit(2)) == 0, one - two).otherwise(two - one).cast("int")


def winner(s1: Column, s2: Column) -> Column:
    """p1 if its doubled score exceeds the other's by more than the handicap of eleven half-points, else p2."""
    return F.when(2 * s1 > 2 * s2 + 11, "p1").otherwise("p2")


def format_move(cell: Column) -> Column:
    return F.concat(F.chr(97 + F.pmod(cell, F.lit(7))), (F.floor(cell / 7) + 1).cast("string"))


def parse_move(text: Column) -> Column:
    """Cell of a move such as d4 (the letter in either case); null if it is none."""
    ok = text.rlike("^[a-gA-G][1-7]$")
    return F.when(ok, (F.substring(text, 2, 1).cast("int") - 1) * 7 + F.ascii(F.lower(text)) - 97)


def scoring_lines() -> list[list[int]]:
    """The 36 lines of two cells or more: rows, columns, both kinds of diagonals."""
    starts = [(r, 0, 0, 1) for r in range(7)] + [(0, c, 1, 0) for c in range(7)]
    starts += [(0, c, 1, 1) for c in range(6)] + [(r, 0, 1, 1) for r in range(1, 6)]
    starts += [(0, c, 1, -1) for c in range(1, 7)] + [(r, 6, 1, -1) for r in range(1, 6)]
    out = []
    for r, c, dr, dc in starts:
        line = []
        while 0 <= r < SIZE and 0 <= c < SIZE:
            line.append(r * SIZE + c)
            r, c = r + dr, c + dc
        out.append(line)
    return out


def pattern_offset(length: int) -> int:
    return sum(3**k for k in range(2, length))


def line_pattern(own: Column, other: Column, line: list[int]) -> Column:
    """Pattern number of a line: base-3 digits (1 own, 2 other), first cell least."""
    digits = [(_right(own, c).bitwiseAND(lit(1)) + _right(other, c).bitwiseAND(lit(1)) * 2) * 3**k for k, c in enumerate(line)]
    return (reduce(lambda x, y: x + y, digits) + pattern_offset(len(line))).cast("int")


def reversal_orbits() -> list[int]:
    """Orbit of every pattern under reversal of its line, numbered in order of the least member."""
    out: list[int] = []
    orbits = 0
    for n in range(2, 8):
        seen: dict[int, int] = {}
        for code in range(3**n):
            back, rest = 0, code
            for _ in range(n):
                back, rest = back * 3 + rest % 3, rest // 3
            least = min(code, back)
            if least not in seen:
                seen[least] = orbits
                orbits += 1
            out.append(seen[least])
    return out


def explode_empty(df: DataFrame, occupied: Column, cell: str = "cell") -> DataFrame:
    """A row for each empty cell."""
    every = df.withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    return every.filter(~has(occupied, F.col(cell)))


def with_gains(df: DataFrame) -> DataFrame:
    """For rows (p1, p2, side) with an empty ``cell``: own_gain and opponent_gain of a piece there."""
    at = bit(F.col("cell"))
    staged = df.withColumns({"__p1n": F.col("p1").bitwiseOR(at), "__p2n": F.col("p2").bitwiseOR(at)})
    staged = with_scores(staged, __s1="p1", __s2="p2", __s1n="__p1n", __s2n="__p2n")
    one, two = F.col("__s1n") - F.col("__s1"), F.col("__s2n") - F.col("__s2")
    first = F.col("side") == 0
    out = staged.withColumns({"own_gain": F.when(first, one).otherwise(two), "opponent_gain": F.when(first, two).otherwise(one)})
    return out.drop("__p1n", "__p2n", "__s1", "__s2", "__s1n", "__s2n")


def valid_move(text: Column, p1: Column, p2: Column) -> Column:
    """Null for a legal move, else why it is none: out_of_bounds before game_over before occupied."""
    cell, taken = parse_move(text), p1.bitwiseOR(p2)
    return F.when(cell.isNull(), "out_of_bounds").when(F.bit_count(taken) == CELLS, "game_over").when(has(taken, F.coalesce(cell, F.lit(0))), "occupied")


def place(p1: Column, p2: Column, side: Column, cell: Column) -> tuple[Column, Column]:
    """Both boards after the side to move has played a cell."""
    return F.when(side == 0, p1.bitwiseOR(bit(cell))).otherwise(p1), F.when(side == 0, p2).otherwise(p2.bitwiseOR(bit(cell)))


def remove(board: Column, cell: Column) -> Column:
    return board.bitwiseAND(F.bitwise_not(bit(cell)))


def replay(moves: Column) -> Column:
    """Boards after an array of cells from the empty board, null if a move is none, repeats or follows the end: struct of p1, p2, ply."""
    legal = ~F.exists(moves, lambda c: c.isNull() | ~c.between(0, CELLS - 1)) & (F.size(F.array_distinct(moves)) == F.size(moves))
    mine = (F.filter(moves, lambda c, i: i % 2 == 0), F.filter(moves, lambda c, i: i % 2 == 1))
    side = [F.aggregate(cells, lit(0), lambda x, c: x.bitwiseOR(bit(c))) for cells in mine]
    return F.when(legal, F.struct(side[0].alias("p1"), side[1].alias("p2"), F.size(moves).alias("ply")))


#: Seeds of the hash of pieces and of the side to move.
PIECE_SEED, SIDE_SEED = 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B


def _mixed(x: int) -> int:
    """A step of SplitMix64 from a state."""
    top = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & top
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & top
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & top
    return x ^ x >> 31


def zobrist(player: int, cell: int) -> int:
    """Hash of a piece; a position's is the exclusive or of its pieces', and of ``zobrist_side`` if player two moves."""
    return _mixed(PIECE_SEED ^ (player << 32 | cell))


def zobrist_side() -> int:
    return _mixed(SIDE_SEED)


def with_hash(df: DataFrame, key: list[str], target: str = "hash") -> DataFrame:
    """The key of every position with its hash, as a BIGINT bit pattern."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pieces = df.sparkSession.createDataFrame([(p, c, signed(zobrist(p, c))) for p in (0, 1) for c in range(CELLS)], "piece_player int, piece_cell int, piece long")  # 98 rows
    placed = df.crossJoin(F.broadcast(pieces)).filter(has(F.when(F.col("piece_player") == 0, F.col("p1")).otherwise(F.col("p2")), F.col("piece_cell")))
    hashed = placed.groupBy(*key).agg(F.bit_xor("piece").alias("x"))
    turn = F.when(F.col("side") == 1, F.lit(signed(zobrist_side()))).otherwise(F.lit(0)).cast("long")
    return df.join(hashed, key, "left").select(*key, F.coalesce("x", F.lit(0)).cast("long").bitwiseXOR(turn).alias(target))


def move_orbit(stabilizer: Column, cell: Column) -> Column:
    """Smallest cell that the symmetries of a position (bits of its stabilizer) take a cell to."""
    moved = [F.element_at(F.array(*[F.lit(transform_cell(k, c)) for c in range(CELLS)]), cell + 1) for k in range(8)]
    return F.least(*[F.when(F.shiftright(stabilizer, k).bitwiseAND(F.lit(1)) == 1, m).otherwise(cell) for k, m in enumerate(moved)])
