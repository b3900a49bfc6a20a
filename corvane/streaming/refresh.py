"""Incremental refresh of a stored catalog.

A stored row is stale when it is missing or older than a timeout; without a timeout whatever exists is fresh. A fresh
application shields all its objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.versions import VersionedTables


def is_stale(modified: Column, now: Column, timeout: float | None) -> Column:
    """Missing, or older than ``timeout`` seconds."""
    if timeout is None:
        return modified.isNull()
    age = F.timestamp_diff("MICROSECOND", modified, now)
    return modified.isNull() | (age > F.lit(int(timeout * 1_000_000)))


def clamp_timeouts(app_timeout: float | None, obj_timeout: float | None) -> tuple[float | None, float | None]:
    """An application may not stay fresh for longer than its objects."""
    if obj_timeout is not None and (app_timeout is None or app_timeout > obj_timeout):
        app_timeout = obj_timeout
    return app_timeout, obj_timeout


def stale_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], now: Column, timeout: float | None) -> DataFrame:
    """Incoming rows whose stored version is missing or too old."""
    stored = existing.select(*keys, F.col("modified").alias("__modified"))
    joined = incoming.join(stored, keys, "left")
    return joined.where(is_stale(F.col("__modified"), now, timeout)).drop("__modified")


def refresh(
    incoming: DataFrame,
    current: DataFrame,
    current_apps: DataFrame,
    now: Column,
    app_timeout: float | None = None,
    obj_timeout: float | None = None,
) -> DataFrame:
    """Stored table after a refresh: stale rows replaced by incoming ones, everything else as it was.

    ``incoming`` and ``current`` are ``(app, object, modified, ...)`` with one row per object, ``current_apps`` is
    ``(app, modified)``. Rows taken over carry ``modified = now``.
    """
    app_timeout, obj_timeout = clamp_timeouts(app_timeout, obj_timeout)
    # An application that is stored but not there any more keeps its rows; one that is not stored is stale.
    fresh_apps = current_apps.where(~is_stale(F.col("modified"), now, app_timeout)).select("app")
    candidates = incoming.join(fresh_apps, "app", "left_anti")
    taken = stale_rows(candidates, current, ["app", "object"], now, obj_timeout).withColumn("modified", now)
    kept = current.join(taken.select("app", "object"), ["app", "object"], "left_anti")
    return kept.withColumn("refreshed", F.lit(False)).unionByName(taken.withColumn("refreshed", F.lit(True)))


def refresh_apps(incoming_apps: DataFrame, current_apps: DataFrame, now: Column, app_timeout: float | None = None) -> DataFrame:
    """Stored applications ``(app, modified, ...)`` after a refresh: missing and stale ones replaced by incoming rows."""
    taken = stale_rows(incoming_apps, current_apps, ["app"], now, app_timeout).withColumn("modified", now)
    kept = current_apps.join(taken.select("app"), "app", "left_anti")
    return kept.withColumn("refreshed", F.lit(False)).unionByName(taken.withColumn("refreshed", F.lit(True)))


def refresh_catalog(
    incoming_apps: DataFrame,
    incoming: DataFrame,
    current_apps: DataFrame,
    current: DataFrame,
    now: Column,
    app_timeout: float | None = None,
    obj_timeout: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Applications and objects after one refresh, by the same clock and the same timeouts."""
    app_timeout, obj_timeout = clamp_timeouts(app_timeout, obj_timeout)
    apps = refresh_apps(incoming_apps, current_apps, now, app_timeout)
    return apps, refresh(incoming, current, current_apps, now, app_timeout, obj_timeout)


def refresh_stored(
    store: VersionedTables,
    incoming_apps: DataFrame,
    incoming: DataFrame,
    now: Column,
    app_timeout: float | None = None,
    obj_timeout: float | None = None,
) -> int:
    """Refresh the stored tables ``apps`` and ``objects`` and publish both as one new version, whose number is returned."""
    old = store.read()
    current_apps = old.get("apps", incoming_apps.limit(0))
    current = old.get("objects", incoming.limit(0))
    apps, objects = refresh_catalog(incoming_apps, incoming, current_apps, current, now, app_timeout, obj_timeout)
    return store.write({"apps": apps.drop("refreshed"), "objects": objects.drop("refreshed")})
