"""Navigation integrity: classification, rejections, cells, connected groups and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import grid_cell, integrity_altitude
from ..session import cut_lineage
from .reports import usable

# At or below these a category counts as low.
LOW = {"nic": 5, "nac_p": 6, "nac_v": 2, "sil": 1, "sda": 1, "gva": 2}


def low_fields() -> Column:
    """How many categories are low."""
    return sum((F.coalesce(F.col(c) <= least, F.lit(False)).cast("int") for c, least in LOW.items()), F.lit(0))


def state() -> Column:
    severe = (low_fields() >= 3) | (F.coalesce(F.col("nic") <= 3, F.lit(False)) & F.coalesce(F.col("sil") <= 1, F.lit(False)))
    return F.when(low_fields() == 0, "NORMAL").when(severe, "SEVERE").when(low_fields() >= 2, "DEGRADED").otherwise("REDUCED")


def rejection(age_s: Column, telemetry_s: Column, most_position: int = 45, most_integrity: int = 90, most_skew: int = 90, refused: Column | None = None) -> Column:
    """The first reason against an observation, null if there is none; ``refused`` says that one was refused all the same."""
    populated = F.coalesce(*(F.col(c).cast("double") for c in LOW)).isNotNull()
    return (
        F.when(~usable(F.col("lat"), F.col("lon")), "no_position").when(F.coalesce(age_s > most_position, F.lit(True)), "stale_position").when(~F.col("source").isin("LOCAL", "NETWORK"), "unsupported_source")
        .when(F.col("on_ground"), "on_ground").when(~populated, "no_integrity_fields").when(F.coalesce(telemetry_s > most_integrity, F.lit(True)), "stale_integrity").when(F.abs(telemetry_s - age_s) > most_skew, "position_integrity_skew")
        .when(F.lit(False) if refused is None else refused, "invalid_telemetry")
    )


def celled(signals: DataFrame) -> DataFrame:
    lat, lon = grid_cell(F.col("lat"), F.col("lon"))
    return signals.withColumns({"lat_cell": lat, "lon_cell": lon, "band": integrity_altitude(F.col("altitude_ft")), "state": state()})


_CELL = ("lat_cell", "lon_cell", "band")


def _confidence(aircraft: Column, local: Column, duration: Column | int, ready: Column | bool) -> Column:
    duration, ready = (x if isinstance(x, Column) else F.lit(x) for x in (duration, ready))
    return F.when((aircraft >= 8) & (local >= 3) & (duration >= 300) & ready, "HIGH").when((aircraft >= 5) | ((aircraft >= 3) & (local >= 3) & (duration >= 120)), "MEDIUM").otherwise("LOW")


def cells(signals: DataFrame) -> DataFrame:
    """Each cell: samples, distinct aircraft in all, by source and affected, medians, the worst state."""
    one = lambda cond: F.countDistinct(F.when(cond, F.col("icao_hex")))
    affected, local = one(F.col("state") != "NORMAL"), one(F.col("source") == "LOCAL")
    worst = F.max(F.when(F.col("state") == "SEVERE", 3).when(F.col("state") == "DEGRADED", 2).when(F.col("state") == "REDUCED", 1).otherwise(0))
    per = celled(signals).groupBy(*_CELL).agg(F.count("*").alias("samples"), F.countDistinct("icao_hex").alias("aircraft"), local.alias("local"), one(F.col("source") == "NETWORK").alias("network"), affected.alias("affected"), F.median("nic").alias("median_nic"), F.median("nac_p").alias("median_nac_p"), worst.alias("worst"))
    named = F.element_at(F.array(*map(F.lit, ("NORMAL", "REDUCED", "DEGRADED", "SEVERE"))), F.col("worst") + 1)
    return per.select(*_CELL, "samples", "aircraft", "local", "network", "affected", "median_nic", "median_nac_p", named.alias("state"), _confidence(F.col("affected"), F.col("local"), 0, F.col("aircraft") >= 3).alias("confidence"))


def baseline(signals: DataFrame) -> DataFrame:
    """Each cell's history: medians, share of low samples, quarter hours, how mature it is."""
    low = F.coalesce(F.col("nic") <= 5, F.lit(False)) | F.coalesce(F.col("nac_p") <= 6, F.lit(False)) | F.coalesce(F.col("nac_v") <= 2, F.lit(False))
    buckets = F.countDistinct(F.floor(F.unix_seconds("observed_at") / 900))
    per = celled(signals).groupBy(*_CELL).agg(F.count("*").alias("samples"), F.countDistinct("icao_hex").alias("aircraft"), buckets.alias("buckets"), *(F.median(c).alias(f"median_{c}") for c in ("nic", "nac_p", "nac_v")), F.round(F.count_if(low) / F.count("*"), 6).alias("low_share"))
    n, a, b = F.col("samples"), F.col("aircraft"), F.col("buckets")
    return per.withColumn("maturity", F.when((a >= 8) & (n >= 20) & (b >= 6), "STRONG").when((a >= 5) & (n >= 20) & (b >= 3), "READY").when((a >= 3) & (n >= 6), "PARTIAL").otherwise("IMMATURE"))


def groups(of: DataFrame) -> DataFrame:
    """Cells with the least cell that is reached over neighbours (eight, in one band): column ``leader``.

    Labels move to neighbours and then along labels, so rounds grow with the
    logarithm of a group's extent; each round is written, which cuts the lineage.
    """
    key = lambda la, lo: F.concat_ws(":", F.lpad((la + 100_000).cast("string"), 6, "0"), F.lpad((lo + 100_000).cast("string"), 6, "0"), F.col("band"))
    nodes = of.select(*_CELL).distinct().withColumn("node", key(F.col("lat_cell"), F.col("lon_cell")))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    edges = nodes.select("node", "band", "lat_cell", "lon_cell", around.alias("d")).select("node", key(F.col("lat_cell") + F.col("d.a"), F.col("lon_cell") + F.col("d.b")).alias("near"))
    edges = cut_lineage(edges.join(nodes.select(F.col("node").alias("near")), "near", "left_semi"))
    labels = cut_lineage(nodes.select("node", F.col("node").alias("leader")))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("leader").alias("leader"))
        jump = seen.join(seen.select(F.col("node").alias("leader"), F.col("leader").alias("further")), "leader").select("node", F.least("leader", "further").alias("leader"))
        following = cut_lineage(jump)
        moved = following.join(labels.withColumnRenamed("leader", "old"), "node").where("leader <> old").limit(1).count()
        labels = following
        if not moved:
            return nodes.join(labels, "node").select(*_CELL, "leader")


def candidates(signals: DataFrame, least_aircraft: int = 3) -> DataFrame:
    """Connected groups of affected cells with enough independent aircraft."""
    all_ = celled(signals)
    bad = all_.where("state <> 'NORMAL'")
    leaders = groups(bad)
    in_group = bad.join(leaders, list(_CELL))
    one = lambda cond: F.countDistinct(F.when(cond, F.col("icao_hex")))
    low = F.coalesce(F.col("nic") <= 5, F.lit(False)) | F.coalesce(F.col("nac_p") <= 6, F.lit(False)) | F.coalesce(F.col("nac_v") <= 2, F.lit(False))
    per = in_group.groupBy("leader").agg(
        F.countDistinct(*_CELL).alias("cells"), F.count("*").alias("samples"), F.countDistinct("icao_hex").alias("aircraft"), one(F.col("source") == "LOCAL").alias("local"), one(F.col("source") == "NETWORK").alias("network"),
        F.median("nic").alias("median_nic"), F.median("nac_p").alias("median_nac_p"), F.round(F.count_if(low) / F.count("*"), 6).alias("low_share"), (F.unix_seconds(F.max("observed_at")) - F.unix_seconds(F.min("observed_at"))).alias("duration_s"),
        F.max(F.when(F.col("state") == "SEVERE", 3).when(F.col("state") == "DEGRADED", 2).otherwise(1)).alias("worst"),
    ).where(F.col("aircraft") >= least_aircraft)
    often = in_group.groupBy("leader", "icao_hex").count().groupBy("leader").agg(F.max("count").alias("most"))
    normal = all_.where("state = 'NORMAL'").join(leaders, list(_CELL)).groupBy("leader").agg(F.countDistinct("icao_hex").alias("normal_aircraft"))
    out = per.join(often, "leader").join(normal, "leader", "left")
    severity = F.element_at(F.array(*map(F.lit, ("REDUCED", "DEGRADED", "SEVERE"))), F.col("worst"))
    return out.select("leader", "cells", "samples", "aircraft", "local", "network", "median_nic", "median_nac_p", "low_share", "duration_s", severity.alias("severity"), F.coalesce("normal_aircraft", F.lit(0)).alias("normal_aircraft"), (F.col("most") / F.col("samples") > 0.5).alias("one_aircraft"), _confidence(F.col("aircraft"), F.col("local"), F.col("duration_s"), True).alias("confidence"))


def quality(signals: DataFrame) -> DataFrame:
    """How often each category is there, and its distribution."""
    long = signals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("value")) for c in LOW))).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("samples"))
