"""Orders dealt by slots: what goes on inside of one in its own task, what it takes over from those before by a row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = 65536


def slot_of(order: str, slot: int = SLOT) -> Column:
    """The slot of a row by a number; rows without one go together, before all others."""
    return F.coalesce(F.floor(F.col(order) / slot).cast("long"), F.lit(-(1 << 60)))


def beside(rows: DataFrame, slots: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows with the other columns of slots, which has a row for each of their keys; null keys are equal."""
    renamed = slots.withColumnsRenamed({k: f"_of{k}" for k in key})
    on = None
    for k in key:
        same = rows[k].eqNullSafe(renamed[f"_of{k}"])
        on = same if on is None else on & same
    return rows.join(renamed, on).drop(*(f"_of{k}" for k in key))
