"""Seeded, engine-independent random order.

Every random choice of the curation loop (shuffle, sample, draw) is an order by
``md5("<seed>:<salt>:<id>")``. It depends on nothing but its inputs, so a retried task or
another partitioning reproduces the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def point_id(source: Column | str, pos: Column) -> Column:
    """Stable id of the point at ``pos`` of ``source``."""
    source = F.lit(source) if isinstance(source, str) else source
    return F.md5(F.concat_ws(":", source, pos.cast("string")))


def random_key(salt: str, id_col: Column, seed: int = DEFAULT_SEED) -> Column:
    """Hex key whose order is the seeded permutation of the ids."""
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), id_col.cast("string")))


def random_below(salt: str, counter: Column, bound: Column, seed: int = DEFAULT_SEED) -> Column:
    """Seeded pseudo-random integer in ``[0, bound)`` for each counter value."""
    head = F.substring(random_key(salt, counter, seed), 1, 15)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), bound.cast("bigint"))
