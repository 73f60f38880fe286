"""Product file catalogues: names to fields, latest versions, snapshot summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.functions.labels import DAILY_NAME, LEGACY_PROTON_NAME, MISSION_NAME, YEARLY_NAME


def version_key(version: str | Column) -> Column:
    """``2-10-1`` as an array of ints, which orders numerically part by part."""
    c = F.col(version) if isinstance(version, str) else version
    return F.transform(F.split(c, "-"), lambda x: x.cast("int"))


def yearly_catalogue(names: DataFrame, name: str = "filename") -> DataFrame:
    """Satellite, year and version of yearly files; whole-mission aggregates are flagged.

    Names of neither kind are left out.
    """
    yearly, mission = F.col(name).rlike(YEARLY_NAME), F.col(name).rlike(MISSION_NAME)
    pick = lambda i, j: F.when(yearly, F.regexp_extract(name, YEARLY_NAME, i)).otherwise(
        F.regexp_extract(name, MISSION_NAME, j))
    return names.filter(yearly | mission).select(
        name, pick(1, 1).cast("int").alias("sat"),
        F.when(yearly, F.regexp_extract(name, YEARLY_NAME, 2).cast("int")).alias("year"),
        pick(3, 4).alias("version"), mission.alias("full_mission"))


def daily_catalogue(names: DataFrame, name: str = "filename") -> DataFrame:
    part = lambda i: F.regexp_extract(name, DAILY_NAME, i)
    return names.filter(F.col(name).rlike(DAILY_NAME)).select(
        name, part(1).alias("cadence"), part(2).cast("int").alias("sat"),
        F.to_date(part(3), "yyyyMMdd").alias("day"), part(4).alias("version"))


def legacy_proton_catalogue(names: DataFrame, name: str = "filename") -> DataFrame:
    """Satellite, instrument, cadence and days of the monthly proton files of the older satellites."""
    part = lambda i: F.regexp_extract(name, LEGACY_PROTON_NAME, i)
    return names.filter(F.col(name).rlike(LEGACY_PROTON_NAME)).select(
        name, part(1).cast("int").alias("sat"), F.lower(part(2)).alias("instrument"), F.lower(part(3)).alias("cadence"),
        F.try_to_date(part(4), "yyyyMMdd").alias("first_day"), F.try_to_date(part(5), "yyyyMMdd").alias("last_day"))


def without_missions(catalogue: DataFrame) -> DataFrame:
    """Drop whole-mission aggregates where the satellite also has yearly files."""
    yearly = catalogue.filter(~F.col("full_mission")).select("sat").distinct()
    missions = catalogue.filter("full_mission").join(yearly, "sat", "left_anti")
    return catalogue.filter(~F.col("full_mission")).unionByName(missions)


def latest_version(catalogue: DataFrame, keys: list[str], name: str = "filename") -> DataFrame:
    """One row per key with the highest version (numeric order)."""
    return (
        catalogue.groupBy(*keys)
        .agg(F.max_by(F.struct("version", name), F.struct(version_key("version"), F.col(name)))
             .alias("_top"))
        .select(*keys, "_top.*")
    )


def snapshot_summary(rows: DataFrame, labels: list[str], time: str) -> DataFrame:
    """Distinct labels (sorted) and time span of a snapshot table."""
    return rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in labels],
                    F.min(time).alias("first_time"), F.max(time).alias("last_time"))
