"""Collision-avoidance advisories and transponder capabilities from downlinked registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import codes


def advisory(word: Column) -> dict[str, Column]:
    """Fields of an advisory (register 3,0), its seven bytes as one number: bits as ints, and what it tells of the threat.

    tti 1: tid is the threat's address; 2: tida its altitude in feet, tidr its range and tidb its
    bearing, raw.
    """
    bit = lambda byte, k: B.field(word, 48 - 8 * byte + k, 1).cast("int")
    tti = B.field(word, 26, 3).cast("int")
    out = {f"ara{41 + k}": bit(1, 7 - k) for k in range(7)}
    out |= {"rac55": bit(2, 1), "rac56": bit(2, 0), "rac57": bit(3, 7), "rac58": bit(3, 6), "rat": bit(3, 5), "mte": bit(3, 4), "tti": tti}
    out["tid"] = F.when(tti == 1, codes.mode_s_hex(B.field(word, 2, 0xFFFFFF)))
    c1, a1 = bit(3, 1), bit(3, 0)
    c2, a2, c4, a4 = (bit(4, k) for k in (7, 6, 5, 4))
    b1, d1, b2 = (bit(4, k) for k in (2, 1, 0))
    d2, b4, d4 = (bit(5, k) for k in (7, 6, 5))
    out["tida"] = F.when(tti == 2, codes.gray_altitude([d1, d2, d4, a1, a2, a4, b1, b2, b4, c1, c2, c4]))
    out["tidr"] = F.when(tti == 2, B.field(word, 6, 127).cast("int"))
    out["tidb"] = F.when(tti == 2, B.field(word, 0, 63).cast("int"))
    return out


def resolution_advisories(plots: DataFrame) -> DataFrame:
    """A row for each plot with an advisory: register 3,0 or, without one, item 260; the plot's columns and bds30_*."""
    message = F.coalesce(F.try_element_at("bds", F.lit("30")), F.col("acas")) if "bds" in plots.columns else F.col("acas")
    told = plots.withColumn("_ra", B.unsigned(message, 1, 7)).filter(F.col("_ra").isNotNull())
    return told.withColumns({f"bds30_{k}": v for k, v in advisory(F.col("_ra")).items()}).drop("_ra")


def latest(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Of rows with one key, the last by order: what replacing one by one leaves."""
    columns = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return last.select(*key, *(F.col(f"_r.{c}").alias(c) for c in columns))


def upsert_advisories(advisories: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row for each sensor and time of day, the last."""
    return latest(advisories, ("sac", "sic", "tod"), order)


def latest_capabilities(plots: DataFrame, order: tuple[str, ...] = ("seq", "rec_index")) -> DataFrame:
    """For each address, the own-status fields and registers 1,0 and 1,7 last seen, each by itself.

    order must tell all records apart: those of one block share its seq.
    """
    own = ("com", "si", "mssc", "arc", "aic", "b1a", "b1b")
    at = F.struct(*order)
    told = plots.filter(F.col("modes").isNotNull())
    if "bds" in plots.columns:
        told = told.withColumns({"bds10": F.try_element_at("bds", F.lit("10")), "bds17": F.try_element_at("bds", F.lit("17"))})
    found = [c for c in (*own, "bds10", "bds17") if c in told.columns]
    return told.groupBy("modes").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in found))


