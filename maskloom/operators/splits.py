"""Exact weighted splits.

A split is a projection: collection name and place follow from the dense 0-based position
of a point, so no row moves between tasks. Sizes are driver-side doubles, multiplied from left to
right, because ``int(w * n)`` depends on that order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import DEFAULT_SEED
from maskloom.operators.index import position_index, random_index


@dataclass(frozen=True)
class Weights:
    """Shares of the data set (A, B, Z) and of the parts of A and B; the defaults are fixed values."""

    A: float = 0.5
    A_train: float = 0.1
    A_val: float = 0.3
    A_test: float = 0.6
    B: float = 0.3
    B_train: float = 0.7
    B_val: float = 0.1
    B_test: float = 0.2
    Z: float = 0.2

    @classmethod
    def of(cls, weights: "Weights | dict") -> "Weights":
        return weights if isinstance(weights, Weights) else cls(**weights)

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


DEFAULT_WEIGHTS = Weights()

# Shares used when no weights are given (fixed values).
FALLBACK_ABZ = (0.4, 0.2, 0.4)
FALLBACK_A_PARTS = (0.1, 0.4, 0.5)
FALLBACK_C_RATIOS = (0.4, 0.1, 0.5)
# Smallest reserve share that is accepted.
MIN_RESERVE = 0.1


def _close(x: float | Column, y: float | Column, tolerance: float) -> bool | Column:
    def size(v):
        return F.abs(v) if isinstance(v, Column) else abs(v)

    return size(x - y) <= 1e-8 + tolerance * size(y)


def _rules(w: Weights, tolerance: float) -> list[tuple[bool | Column, str]]:
    """(does it hold?, message) of the five rules, for numbers or columns."""
    return [
        (_close(w.A_train + w.A_val + w.A_test, 1, tolerance), "A_train + A_val + A_test must be 1"),
        (_close(w.B_train + w.B_val + w.B_test, 1, tolerance), "B_train + B_val + B_test must be 1"),
        (_close(w.A + w.B + w.Z, 1, tolerance), "A + B + Z must be 1"),
        (_close(w.A * w.A_test, w.B, tolerance), "A * A_test must be B"),
        (w.Z >= MIN_RESERVE, f"Z must be at least {MIN_RESERVE}"),
    ]


def validate_weights(weights: Weights | dict, tolerance: float = 1e-6) -> bool:
    """Check the five rules in order; the first broken one raises ``ValueError``."""
    for holds, message in _rules(Weights.of(weights), tolerance):
        if not holds:
            raise ValueError(message)
    return True


def broken_rule(tolerance: float = 1e-6) -> Column:
    """Message of the first rule that a row of weights breaks, null if all hold.

    The row has a column for each field of ``Weights``; a null breaks the rules it stands in.
    """
    w = Weights(*[F.col(f.name).cast("double") for f in fields(Weights)])
    return F.coalesce(
        *[F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)) for holds, message in _rules(w, tolerance)]
    )


def abz_sizes(n: int, weights: Weights | dict | None = None) -> tuple[int, int, int]:
    """Sizes of A, B and Z for ``n`` points; what truncation leaves over is dropped."""
    if weights:
        w = Weights.of(weights)
        shares = (w.A, w.B, w.Z)
    else:
        shares = FALLBACK_ABZ
    return tuple(int(share * n) for share in shares)


def a_part_sizes(n: int, weights: Weights | dict | None = None) -> tuple[int, int, int]:
    """Sizes of A_train, A_val and A_test."""
    if weights:
        w = Weights.of(weights)
        whole, parts = w.A, (w.A_train, w.A_val, w.A_test)
    else:
        whole, parts = FALLBACK_ABZ[0], FALLBACK_A_PARTS
    return tuple(int(whole * part * n) for part in parts)


def c_part_sizes(
    n: int,
    weights: Weights | dict | None = None,
    ratios: tuple[float, float, float] = FALLBACK_C_RATIOS,
    threshold: float = 1e-6,
) -> tuple[int, int, int]:
    """Sizes of C_train, C_val and C_test.

    The ratios are checked even when weights override them. The sizes sum to about size(B), half
    of C; the rest of C is not used.
    """
    if not 1 - threshold <= sum(ratios) <= 1 + threshold:
        raise ValueError("train, validation and test ratios must sum to 1")
    if weights:
        w = Weights.of(weights)
        whole, parts = w.B, (w.B_train, w.B_val, w.B_test)
    else:
        whole, parts = FALLBACK_ABZ[1], ratios
    return tuple(int(whole * part * n) for part in parts)


def slice_name(pos: Column, parts: Sequence[tuple[str, int]], start: int = 0) -> Column:
    """Name of the contiguous slice holding ``pos``; null before the first and past the last."""
    named = F.when(pos < start, F.lit(None).cast("string"))
    for name, size in parts:
        start += size
        named = named.when(pos < start, F.lit(name))
    return named


def slice_ord(pos: Column, parts: Sequence[tuple[str, int]], start: int = 0) -> Column:
    """Place of ``pos`` inside its slice."""
    placed = F.when(pos < start, F.lit(None).cast("bigint"))
    for _, size in parts:
        end = start + size
        placed = placed.when(pos < end, (pos - start).cast("bigint"))
        start = end
    return placed


def split_slices(
    points: DataFrame, parts: Sequence[tuple[str, int]], pos: str = "pos"
) -> DataFrame:
    """(collection, point_id, ord) of contiguous slices by dense position. Map-only.

    A slice reaching past the last point is simply short.
    """
    end = sum(size for _, size in parts)
    # The plain range filter is what reaches the parquet scan.
    inside = points.filter((F.col(pos) >= 0) & (F.col(pos) < end))
    return inside.select(
        slice_name(F.col(pos), parts).alias("collection"),
        "point_id",
        slice_ord(F.col(pos), parts).alias("ord"),
    )


def abz_split(
    points: DataFrame, n: int | None = None, weights: Weights | dict | None = None, pos: str = "pos"
) -> DataFrame:
    """Split points in input order into A, B and Z; ``n`` says how many, None means all."""
    n = points.count() if n is None else n
    return split_slices(points, list(zip("ABZ", abz_sizes(n, weights))), pos)


def train_val_test_split(
    members: DataFrame,
    train: int,
    val: int,
    test: int,
    shuffle: bool = True,
    prefix: str = "",
    salt: str = "split",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Split one collection (point_id, ord) by counts, optionally after a seeded shuffle."""
    end = train + val + test
    if shuffle:
        ranked = random_index(members, salt, seed=seed, name="_idx", first=end)
    else:
        ranked = position_index(members, name="_idx")
    parts = [(f"{prefix}train", train), (f"{prefix}val", val), (f"{prefix}test", test)]
    return split_slices(ranked.select("point_id", "_idx"), parts, "_idx")


def setup_split(
    points: DataFrame, n: int | None = None, weights: Weights | dict | None = None, pos: str = "pos"
) -> DataFrame:
    """Whole set-up: check weights, make A, B, Z and the three parts of A.

    ``n`` says how many points are split, None means all. One map-only projection: a point of A is written to A and, if a part holds it, to that part.
    """
    if weights:
        validate_weights(weights)
    n = points.count() if n is None else n
    sizes = abz_sizes(n, weights)
    groups = list(zip("ABZ", sizes))
    parts = list(zip(("A_train", "A_val", "A_test"), a_part_sizes(n, weights)))
    at = F.col(pos)
    # The parts are cut out of A itself and cannot reach past its end.
    in_a = at < sizes[0]
    rows = F.array(
        F.struct(slice_name(at, groups).alias("collection"), slice_ord(at, groups).alias("ord")),
        F.struct(
            F.when(in_a, slice_name(at, parts)).alias("collection"),
            F.when(in_a, slice_ord(at, parts)).alias("ord"),
        ),
    )
    return (
        points.filter((at >= 0) & (at < sum(sizes)))
        .select("point_id", F.explode(rows).alias("row"))
        .filter(F.col("row.collection").isNotNull())
        .select("row.collection", "point_id", "row.ord")
    )


def source_ranges(
    name: str, n: int, weights: Weights | dict | None = None, balance: bool = False
) -> list[tuple[int, int]]:
    """Positions that members of a collection can have after any number of cycles.

    Points enter A_test and B from Z only, and A_train from A_test and B; balancing mixes the
    three. A table written in order of position is skipped by row group outside the ranges.
    """
    a, b, z = abz_sizes(n, weights)
    train, val, test = a_part_sizes(n, weights)
    slices = {
        "A_train": (0, train),
        "A_val": (train, train + val),
        "A_test": (train + val, train + val + test),
        "B": (a, a + b),
        "Z": (a + b, a + b + z),
    }
    moving = ("A_train", "A_test", "B", "Z")
    origins = {
        "A_train": moving,
        "A_val": ("A_val",),
        "A_test": moving if balance else ("A_test", "Z"),
        "B": moving if balance else ("B", "Z"),
        "Z": ("Z",),
    }
    origins["A_test_pred"] = origins["A_test"]
    if name == "A":
        return [(0, a)]
    # C, D and their parts come from A_test and B.
    wanted = origins.get(name, moving if balance else ("A_test", "B", "Z"))
    return [slices[part] for part in wanted]


def in_ranges(pos: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Range filter that parquet row groups are skipped by."""
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | ((pos >= start) & (pos < end))
    return inside


def c_split(
    c_members: DataFrame,
    sizes: tuple[int, int, int],
    salt: str = "shuffle",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Shuffle C and cut C_train, C_val and C_test out of it, ids only."""
    return train_val_test_split(
        c_members, *sizes, shuffle=True, prefix="C_", salt=salt, seed=seed
    )
