"""Membership steps of the curation loop, on narrow rows.

Membership frames here are (collection, point_id, ord, value): ``value`` is the label of a C or D
row (1 machine, 0 expert) and the verdict of a C_test_pred row, else null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import DEFAULT_SEED
from maskloom.operators.index import random_index
from maskloom.operators.registry import move
from maskloom.operators.sampling import draw_one, sample_percent
from maskloom.operators.splits import slice_name, slice_ord

MACHINE, EXPERT = 1, 0
# Membership rows that may be broadcast to a join with pixels (about 100 bytes each).
BROADCAST_ROWS = 500_000


def members_of(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.col("collection") == name).select("point_id", "ord")


def attach(points: DataFrame, members: DataFrame, n_members: int) -> DataFrame:
    """Pixels of the members.

    A membership known to be small is broadcast, so that pixels are filtered where they are read.
    Past ``BROADCAST_ROWS`` a table in chunks is joined by chunk, which moves no pixels; any other
    one is a plain join, which on a table bucketed by point id shuffles the membership only.
    """
    if n_members <= BROADCAST_ROWS:
        return points.join(F.broadcast(members), "point_id")
    if "chunk" in points.columns:
        return _attach_by_chunk(points, members)
    return points.join(members, "point_id")


def _attach_by_chunk(points: DataFrame, members: DataFrame) -> DataFrame:
    """Members are gathered into a row per chunk, at most ``CHUNK`` of them; that row meets the chunk's pixels.

    Members learn their position from the two narrow columns of the table. The join hashes the small
    side, so pixel rows are neither moved nor sorted.
    """
    more = [c for c in members.columns if c != "point_id"]
    located = members.join(points.select("point_id", "pos", "chunk"), "point_id")
    # A field of its own keeps members without further columns apart from points that are none.
    entry = F.struct("pos", F.struct(F.lit(True).alias("_member"), *more).alias("held"))
    chunks = located.groupBy("chunk").agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    joined = points.join(chunks.hint("shuffle_hash"), "chunk").withColumn("_one", F.try_element_at("_held", F.col("pos")))
    columns = [c for c in points.columns if c != "chunk"]
    return joined.where("_one._member").select(*columns, "chunk", *[F.col(f"_one.{c}").alias(c) for c in more])


def build_c(
    machine: DataFrame, expert: DataFrame, n_machine: int, n_expert: int, strict: bool = True
) -> DataFrame:
    """C as (point_id, place, value): predictions of A_test first, then B.

    ``strict`` demands equally many of both.
    """
    if strict and n_machine != n_expert:
        raise ValueError(f"A_test has {n_machine} points and B {n_expert}; they must be equal")

    def labelled(rows: DataFrame, side: int, label: int) -> DataFrame:
        place = F.struct(F.lit(side).alias("side"), "ord").alias("place")
        return rows.select("point_id", place, F.lit(label).alias("value"))

    return labelled(machine, 0, MACHINE).unionByName(labelled(expert, 1, EXPERT))


def shuffle_c(c_rows: DataFrame, cycle: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """C in the random order of a cycle: (point_id, value, ord)."""
    return random_index(
        c_rows.select("point_id", "value"), f"shuffle{cycle}", seed=seed, name="ord"
    )


def slice_c(c_shuffled: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """Membership rows of C_train, C_val and C_test. Map-only."""
    parts = list(zip(("C_train", "C_val", "C_test"), sizes))
    at = F.col("ord")
    return c_shuffled.filter(at < sum(sizes)).select(
        slice_name(at, parts).alias("collection"),
        "point_id",
        slice_ord(at, parts).alias("ord"),
        "value",
    )


def machine_labels(c_test: DataFrame, verdicts: DataFrame) -> DataFrame:
    """D: rows of C_test (point_id, ord, value) whose verdict is machine."""
    judged = verdicts.filter(F.col("verdict") == MACHINE).select("point_id")
    return c_test.join(judged, "point_id")


def with_origin(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``origin``: A_test if it holds the id, else B, else null."""
    a_test = members_of(registry, "A_test").select("point_id", F.lit("A_test").alias("_a"))
    b = members_of(registry, "B").select("point_id", F.lit("B").alias("_b"))
    return (
        ids.join(a_test, "point_id", "left")
        .join(b, "point_id", "left")
        .withColumn("origin", F.coalesce("_a", "_b"))
        .drop("_a", "_b")
    )


def select_for_relabel(
    d_rows: DataFrame, registry: DataFrame, percent: int, cycle: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Sample of D with its rank and origin: (point_id, value, idx, origin)."""
    sample = sample_percent(
        d_rows.select("point_id", "value"), percent, f"relabel{cycle}", seed
    )
    return with_origin(sample, registry)


def lost_points(selected: DataFrame) -> DataFrame:
    """Sampled ids found in neither A_test nor B."""
    return selected.filter(F.col("origin").isNull()).select("point_id")


def relabel_moves(ranked: DataFrame) -> DataFrame:
    """Moves of the relabelled points from their origin to A_train."""
    return ranked.select(
        "point_id",
        F.col("origin").alias("source"),
        F.lit("A_train").alias("target"),
        F.col("rank"),
    )


def refill_moves(
    ranked: DataFrame, registry: DataFrame, n_moved: int, cycle: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Moves from Z: the i-th random draw goes where the i-th relabelled point came from."""
    draws = random_index(
        members_of(registry, "Z").select("point_id"), f"fill{cycle}", seed=seed, name="rank",
        first=n_moved,
    )
    return draws.join(ranked.select("rank", F.col("origin").alias("target")), "rank").select(
        "point_id", F.lit("Z").alias("source"), "target", "rank"
    )


# --- balancing ------------------------------------------------------------------------------

BALANCED = ("A_train", "B", "A_test")


def balance_plan(sizes: Mapping[str, int]) -> list[tuple[str, str, int]]:
    """(donor, receiver, count) that bring A_train, B and A_test towards a third each.

    A donor keeps one point more than the third. If only the largest set is above the third, the
    middle one is filled up to it first and the smallest one with what is left to give; if two
    sets are above it, both give to the smallest. Equal sizes rank in the order of ``BALANCED``.
    """
    third = sum(sizes[name] for name in BALANCED) // 3
    largest, middle, smallest = sorted(BALANCED, key=lambda name: -sizes[name])
    spare = {name: max(0, sizes[name] - third - 1) for name in (largest, middle)}
    if sizes[middle] > third:
        plan = [(largest, smallest, spare[largest]), (middle, smallest, spare[middle])]
    else:
        filling = min(third - sizes[middle], spare[largest])
        rest = min(third - sizes[smallest], spare[largest] - filling)
        plan = [(largest, middle, filling), (largest, smallest, rest)]
    return [step for step in plan if step[2]]


def balance_moves(
    registry: DataFrame, plan: list[tuple[str, str, int]], cycle: int, seed: int = DEFAULT_SEED
) -> DataFrame | None:
    """Random points for a balance plan; the first ones of a donor go to its first receiver."""
    moves = None
    donors = list(dict.fromkeys(donor for donor, _, _ in plan))
    for number, donor in enumerate(donors):
        shares = [(receiver, count) for d, receiver, count in plan if d == donor]
        picks = random_index(
            members_of(registry, donor).select("point_id"), f"balance{cycle}", seed=seed,
            first=sum(count for _, count in shares),
        )
        rows = picks.select(
            "point_id",
            F.lit(donor).alias("source"),
            slice_name(F.col("idx"), shares).alias("target"),
            # Two donors may feed one receiver: keep their ranks apart.
            (F.col("idx") * len(donors) + number).alias("rank"),
        )
        moves = rows if moves is None else moves.unionByName(rows)
    return moves


def transfer_one(
    registry: DataFrame, source: str, target: str, salt: str = "transfer", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Move one random point from source to target."""
    chosen = draw_one(members_of(registry, source), salt, seed).filter("point_id IS NOT NULL")
    moves = chosen.select(
        "point_id", F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(0).alias("rank")
    )
    return move(registry, moves, strict=False)
