"""Coordinates for stops and road paths for legs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..session import stored
from ..sources.tables import PATH, Tables


def geocode_worklist(t: Tables, force: bool = False) -> DataFrame:
    """Stops still without a lookup, or all of them."""
    todo = t.stop if force else t.stop.filter("geocoded_at IS NULL")
    return todo.select("id", "name")


def resolve_coordinates(worklist: DataFrame, primary: DataFrame, fallback: DataFrame,
                        primary_name: str = "google",
                        fallback_name: str = "nominatim") -> DataFrame:
    """Coordinates from the first lookup table that knows the name.

    Lookups hold (name, lat, lon), one row per name. A stop neither knows is marked
    ``notfound`` with no coordinates, so it is not asked for again.
    """
    p = primary.select("name", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    f = fallback.select("name", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    hit_p, hit_f = F.col("p_lat").isNotNull(), F.col("f_lat").isNotNull()
    return (worklist.join(p, "name", "left").join(f, "name", "left")
            .select("id", "name",
                    F.when(hit_p, F.col("p_lat")).otherwise(F.col("f_lat")).alias("lat"),
                    F.when(hit_p, F.col("p_lon")).otherwise(F.col("f_lon")).alias("lon"),
                    F.when(hit_p, primary_name).when(hit_f, fallback_name)
                    .otherwise("notfound").alias("geocode_source")))


def geocode_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("geocode_source").agg(F.count(F.lit(1)).alias("stops"))


def apply_geocodes(t: Tables, resolved: DataFrame, at) -> DataFrame:
    """The stop table with the resolved rows filled in."""
    r = resolved.select("id", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"),
                        F.col("geocode_source").alias("n_source"))
    new = F.col("n_source").isNotNull()
    return (t.stop.join(r, "id", "left")
            .select("id", "name",
                    F.when(new, F.col("n_lat")).otherwise(F.col("lat")).alias("lat"),
                    F.when(new, F.col("n_lon")).otherwise(F.col("lon")).alias("lon"),
                    F.when(new, at).otherwise(F.col("geocoded_at")).alias("geocoded_at"),
                    F.when(new, F.col("n_source")).otherwise(F.col("geocode_source"))
                    .alias("geocode_source")))


def distinct_legs(t: Tables) -> DataFrame:
    """Distinct legs between two different stops that both have coordinates."""
    pairs = (t.next_stop.filter("from_stop_id <> to_stop_id")
             .select("from_stop_id", "to_stop_id").distinct())
    placed = t.stop.filter("lat IS NOT NULL")
    a = placed.select(F.col("id").alias("from_stop_id"), F.col("lat").alias("from_lat"),
                      F.col("lon").alias("from_lon"))
    b = placed.select(F.col("id").alias("to_stop_id"), F.col("lat").alias("to_lat"),
                      F.col("lon").alias("to_lon"))
    return pairs.join(a, "from_stop_id").join(b, "to_stop_id").select(
        "from_stop_id", "to_stop_id", "from_lat", "from_lon", "to_lat", "to_lon")


def leg_worklist(t: Tables, force: bool = False) -> DataFrame:
    """Legs still without a road path."""
    legs = distinct_legs(t)
    if force:
        return legs
    return legs.join(t.leg_geometry.filter("path IS NOT NULL"),
                     ["from_stop_id", "to_stop_id"], "left_anti")


def decode_batch(lines: list[str]) -> list[np.ndarray]:
    """The points of encoded polylines, one (n, 2) array of degrees for each line.

    All lines are read at once: a character under 32 (less 63) ends a number, the five low
    bits of each character are shifted by its place in its number and added up, the lowest
    bit is the sign, and running sums within a line turn differences into places.
    """
    lengths = np.array([len(s) for s in lines], np.int64)
    code = np.frombuffer("".join(lines).encode("ascii"), np.uint8).astype(np.int64) - 63
    ends = np.flatnonzero(code < 32)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))[:len(ends)]
    place = np.arange(len(code)) - np.repeat(starts, ends - starts + 1)
    number = np.add.reduceat((code % 32) << 5 * place, starts) if len(starts) else starts
    step = np.where(number % 2 == 1, -(number + 1) // 2, number // 2).reshape(-1, 2)
    # Every two numbers are a point; a line's points end where its characters do.
    upto = np.searchsorted(ends, np.cumsum(lengths)) // 2
    total = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(step, axis=0)))
    first = np.concatenate((np.zeros(1, np.int64), upto[:-1]))[:len(lines)]
    return [(total[i + 1:j + 1] - total[i]) / 1e5 for i, j in zip(first, upto)]


@F.pandas_udf(T.ArrayType(PATH))
def decode_polylines(rows: pd.Series) -> pd.Series:
    """Arrays of encoded polylines as arrays of paths, decoded an Arrow batch at a time."""
    flat = [s or "" for r in rows if r is not None for s in r]
    found = iter(decode_batch(flat))
    return pd.Series([None if r is None else [
        [{"lat": a, "lon": b} for a, b in next(found).tolist()] for _ in r] for r in rows],
        index=rows.index, dtype=object)


def paths_from_steps(legs: DataFrame) -> DataFrame:
    """Leg paths from encoded steps: (from_stop_id, to_stop_id, length_m, step_lines
    array<string>, overview_line). Steps are joined without repeating joints; a leg with
    no steps uses its overview line.
    """
    lines = F.when(F.size("step_lines") > 0, F.col("step_lines")).otherwise(
        F.array("overview_line"))
    # Written, so that no later step decodes a line again.
    pieces = stored(legs.select("from_stop_id", "to_stop_id", "length_m",
                                decode_polylines(lines).alias("pieces")), "leg-pieces")
    return (pieces
            .select("from_stop_id", "to_stop_id", "length_m",
                    geo.join_paths("pieces").alias("path")))


def build_leg_geometry(paths: DataFrame, source: str, at) -> DataFrame:
    """Leg rows with their bounding box; legs without points are left out."""
    return (paths.filter(F.size("path") > 0).withColumn("box", geo.bounding_box("path"))
            .select("from_stop_id", "to_stop_id", "path",
                    F.col("length_m").cast("double").alias("length_m"), "box.*",
                    F.lit(source).alias("source"), at.alias("fetched_at")))


def upsert_leg_geometry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored legs with newly fetched ones over them: a new row replaces the old one of its
    leg, a leg that no new row is for stays as it was. Of several new rows of a leg the one
    fetched last counts."""
    key = ["from_stop_id", "to_stop_id"]
    last = F.max_by(F.struct(*old.columns), F.struct("fetched_at", "length_m"))
    fresh = new.filter(F.size("path") > 0).groupBy(*key).agg(last.alias("r")).select("r.*")
    return old.join(fresh.select(*key), key, "left_anti").select(*old.columns).unionByName(fresh)
