"""Reports over logged searches, and the search event to row mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio_tenths, ratio_whole
from ..sources.tables import Tables


def event_rows(events: DataFrame, *more: str) -> DataFrame:
    """Search events as search rows, with columns ``more``: a stop id wins over coordinates, as
    in requests.

    Events hold (event_id, endpoint, from_/to_ (stop_id, lat, lon), options, duration_ms,
    searched_at) with ``options`` an array of (timetable_number, route_label, day_type,
    departure_count).
    """
    def side(s):
        stop, lat, lon = (F.col(f"{s}_{c}") for c in ("stop_id", "lat", "lon"))
        pin = stop.isNull()
        return [F.when(~pin, "stop").when(lat.isNotNull() & lon.isNotNull(), "pin").alias(f"{s}_kind"),
                stop.alias(f"{s}_stop_id"), F.when(pin, lat).alias(f"{s}_lat"),
                F.when(pin, lon).alias(f"{s}_lon")]
    return events.select(F.col("event_id").alias("id"), "endpoint", *side("from"), *side("to"),
                         F.coalesce(F.size("options"), F.lit(0)).alias("option_count"),
                         "duration_ms", "searched_at", *more)


def option_rows(events: DataFrame) -> DataFrame:
    """One row per option an event returned."""
    return events.select(F.col("event_id").alias("search_id"), F.explode("options").alias("o")).select(
        "search_id", "o.*")


ROUTE_KEY = ["route_label", "timetable_number", "day_type"]


def route_counts(options: DataFrame) -> DataFrame:
    """Searches that returned each route, and the departures offered.

    Options of one search are merged first, so the distinct count is a plain count of
    the merged rows and a popular route is pre-summed on every task.
    """
    per_search = options.groupBy(*ROUTE_KEY, "search_id").agg(F.sum("departure_count").alias("d"))
    return per_search.groupBy(*ROUTE_KEY).agg(F.count(F.lit(1)).alias("searches"),
                                              F.sum("d").alias("departures_offered"))


def pair_counts(searches: DataFrame) -> DataFrame:
    """Searches between two stops (null: a pin), the options found and searches without any."""
    return searches.groupBy("from_stop_id", "to_stop_id").agg(
        F.count(F.lit(1)).alias("searches"), F.sum("option_count").cast("bigint").alias("options"),
        F.count("option_count").alias("answered"), F.count_if(F.col("option_count") == 0).alias("failed_searches"))


def hour_counts(searches: DataFrame) -> DataFrame:
    return searches.groupBy(F.date_trunc("hour", "searched_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("searches"))


def _counts(t: Tables, name: str, made) -> DataFrame:
    """Counts as a feed keeps them, or made of the rows."""
    return getattr(t, name) if name in t.names() else made()


def route_demand(t: Tables, limit: int | None = 20) -> DataFrame:
    """Routes by number of searches that returned them."""
    out = _counts(t, "route_counts", lambda: route_counts(t.search_analytics_option))
    return _top(out, "searches", ROUTE_KEY, limit)


def _top(df, by, ties, limit):
    ordered = df.orderBy(F.desc(by), *ties)
    return ordered.limit(limit) if limit else ordered


def _named(t: Tables, counts: DataFrame, pin) -> DataFrame:
    """Counts by pair of stops with the names of both ends; ``pin`` names what is no stop."""
    a = t.stop.select(F.col("id").alias("from_stop_id"), F.col("name").alias("from_name"))
    b = t.stop.select(F.col("id").alias("to_stop_id"), F.col("name").alias("to_name"))
    return (counts.join(a, "from_stop_id", "left").join(b, "to_stop_id", "left")
            .withColumn("origin", F.coalesce("from_name", pin("from")))
            .withColumn("destination", F.coalesce("to_name", pin("to"))))


def _by_stops(t: Tables) -> DataFrame:
    """Counts per (origin, destination) text, summed on ids before names are joined."""
    counts = _counts(t, "pair_counts", lambda: pair_counts(t.search_analytics))
    return _named(t, counts, lambda s: F.lit("dropped pin")).groupBy("origin", "destination").agg(
        *(F.sum(c).alias(c) for c in ("searches", "options", "answered", "failed_searches")))


def popular_pairs(t: Tables, limit: int | None = 20) -> DataFrame:
    """Most searched origin-destination pairs with their average number of results."""
    out = _by_stops(t).select("origin", "destination", "searches",
                              ratio_tenths("options", "answered").alias("avg_results"))
    return _top(out, "searches", ["origin", "destination"], limit)


def unmet_demand(t: Tables, by_pin: bool = False, limit: int | None = 20) -> DataFrame:
    """Searches that found nothing; ``by_pin`` names pins by their rounded position."""
    if by_pin:
        failed = t.search_analytics.filter("option_count = 0")
        for s in ("from", "to"):
            at = [F.format_string("%.3f", F.round(f"{s}_{c}", 3)) for c in ("lat", "lon")]
            label = F.concat(F.lit("pin "), at[0], F.lit(","), at[1])
            failed = failed.withColumn(f"{s}_pin", F.when(F.col(f"{s}_stop_id").isNull(), label))
        sums = failed.groupBy("from_stop_id", "to_stop_id", "from_pin", "to_pin").agg(
            F.count(F.lit(1)).alias("failed_searches"))
        out = _named(t, sums, lambda s: F.col(f"{s}_pin")).groupBy("origin", "destination").agg(
            F.sum("failed_searches").alias("failed_searches"))
    else:
        out = _by_stops(t).filter("failed_searches > 0").select("origin", "destination", "failed_searches")
    return _top(out, "failed_searches", ["origin", "destination"], limit)


def searches_per_hour(t: Tables, limit: int | None = 24) -> DataFrame:
    """Searches by hour, latest first."""
    ordered = _counts(t, "searches_by_hour", lambda: hour_counts(t.search_analytics)).orderBy(F.desc("hour"))
    return ordered.limit(limit) if limit else ordered


def endpoint_cost(t: Tables) -> DataFrame:
    """Searches, average results and average time by endpoint and kind of origin."""
    sums = t.search_analytics.groupBy("endpoint", F.col("from_kind").alias("searched_from")).agg(
        F.count(F.lit(1)).alias("searches"), F.sum("option_count").alias("s"),
        F.count("option_count").alias("c"), F.sum("duration_ms").alias("d"),
        F.count("duration_ms").alias("e"))
    return sums.select("endpoint", "searched_from", "searches", ratio_tenths("s", "c").alias("avg_results"),
                       ratio_whole("d", "e").alias("avg_milliseconds")).orderBy(
        "endpoint", "searched_from")
