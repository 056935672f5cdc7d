"""Temporal map operators: merged layers, state per year, flow, milestones, cross-checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions.geo import (
    FLOOR_YEAR, active_at, category_rank, cell_key, code_parts, code_prefix, flows_forward, haversine_km,
)
from citeloom.operators.ordered import last_known


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Features of all layers with a ``layer`` column; columns a layer lacks are null."""
    tagged = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def bundle_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("layer").agg(F.count(F.lit(1)).alias("features"))


def layer_counts(features: DataFrame) -> DataFrame:
    """Features per category that occurs, with the category's place in the display order."""
    return features.groupBy("category").agg(F.count(F.lit(1)).alias("features")) \
        .withColumn("place", category_rank(F.col("category")))


def override(features: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """values(key, column) replace the column where the key matches."""
    other = values.select(key, F.col(column).alias("_new"))
    return features.join(other, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def clamp_floor(start: Column, floor: int = FLOOR_YEAR) -> Column:
    """Years before ``floor`` become ``floor``; a missing year stays missing."""
    return F.when(start < floor, floor).otherwise(start)


def normalise_connections(rows: DataFrame) -> DataFrame:
    """Connections under the line-feature schema: name, start year, geometry and combined note."""
    def some(name: str) -> Column:
        return F.when(F.coalesce(name, F.lit("")) != "", F.col(name))

    source = F.when(some("source").isNotNull(), F.concat(F.lit("("), "source", F.lit(")")))
    note = F.concat(F.coalesce(F.concat(some("note"), F.lit(" ")), F.lit("")), F.coalesce(source, F.lit("")))

    def year(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name))

    return rows.select(
        "id", F.coalesce(some("label"), F.col("id")).alias("name"), "kind",
        F.coalesce(year("from"), F.lit(FLOOR_YEAR)).alias("from"), year("to").alias("to"), "approx", "traced",
        F.col("waypoints").alias("geometry"), note.alias("note"),
    )


def shaft_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.replace(name, F.lit(" "), F.lit("-"))))


def _shaft_rows(rows: DataFrame, feature_id: Column, kind: str, start: Column, approx: Column) -> DataFrame:
    return rows.select(
        feature_id.alias("id"), "name", "lat", "lng", F.lit(kind).alias("type"), start.cast("int").alias("from"),
        approx.alias("approx"), F.coalesce("source", F.lit("")).alias("note"),
    )


def merge_shafts(first: DataFrame, second: DataFrame, vents: DataFrame, default_year: int = 1985) -> DataFrame:
    """Shafts of the first source, those of the second in cells the first leaves empty, and all vents.

    The second source is compared with the first only, never with itself: an anti-join on the cell, no
    distance join.
    """
    mine = _shaft_rows(first, F.col("id"), "drop-shaft", F.coalesce("from", F.lit(default_year)),
                       F.coalesce("approx", F.lit(False)))
    free = second.withColumn("_cell", cell_key(F.col("lat"), F.col("lng"))).join(
        first.select(cell_key(F.col("lat"), F.col("lng")).alias("_cell")).distinct(), "_cell", "left_anti")
    theirs = _shaft_rows(free, shaft_id("news-", F.col("name")), "drop-shaft", F.lit(default_year), F.lit(True))
    air = _shaft_rows(vents, shaft_id("vent-", F.col("name")), "air-vent", F.lit(default_year), F.lit(True))
    return mine.unionByName(theirs).unionByName(air)


def visible(features: DataFrame, year: int, categories: list[str] | None = None) -> DataFrame:
    """Features that exist in ``year``, of the chosen categories."""
    rows = features.filter(active_at(F.lit(year), F.col("from"), F.col("to")))
    return rows.filter(F.col("category").isin(*categories)) if categories is not None else rows


def active_over_years(features: DataFrame, first: int, last: int) -> DataFrame:
    """One row per feature and year it exists in, between ``first`` and ``last``."""
    clipped = features.withColumn("_a", F.greatest("from", F.lit(first))) \
        .withColumn("_b", F.least(F.coalesce("to", F.lit(last)), F.lit(last))).filter("_a <= _b")
    return clipped.withColumn("year", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def active_counts(features: DataFrame, by: str, first: int, last: int) -> DataFrame:
    """Features per category and year without a row per feature and year.

    Each feature adds one at its first year and takes one away after its last; the sums per (category, year)
    are small and are accumulated along the years.
    """
    start = F.greatest("from", F.lit(first))
    stop = F.least(F.coalesce("to", F.lit(last)), F.lit(last)) + 1
    steps = features.filter((start <= last) & (stop > start)).select(by, F.explode(F.array(
        F.struct(start.alias("year"), F.lit(1).alias("d")), F.struct(stop.alias("year"), F.lit(-1).alias("d")))).alias("s"))
    deltas = steps.groupBy(by, F.col("s.year").alias("year")).agg(F.sum("s.d").alias("d"))
    grid = deltas.select(by).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    run = Window.partitionBy(by).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(deltas, [by, "year"], "left").withColumn("active", F.sum(F.coalesce("d", F.lit(0))).over(run))
    return full.filter("active > 0").select(by, "year", "active")


def flow_at(features: DataFrame, specs: DataFrame, year: Column) -> DataFrame:
    """Features with the first flow spec(id, ordinal, from, to, dest_lat, dest_lng) whose era contains the year.

    The spec is chosen once per distinct (id, year), then joined back, so geometries are never grouped and an
    id shared by many features costs one look-up.
    """
    wanted = features.withColumn("_year", year)
    s = specs.select("id", F.struct(*[c for c in specs.columns if c != "id"]).alias("spec"))
    asked = wanted.select("id", "_year").distinct().join(s, "id")
    first = asked.filter(active_at(F.col("_year"), F.col("spec.from"), F.col("spec.to"))) \
        .groupBy("id", "_year").agg(F.min_by("spec", "spec.ordinal").alias("spec"))
    forward = flows_forward(F.col("geometry"), F.col("spec.dest_lat"), F.col("spec.dest_lng"))
    return wanted.join(first, ["id", "_year"]).select(
        *features.columns, F.col("spec.ordinal").alias("ordinal"), forward.alias("forward"))


def milestone_asof(questions: DataFrame, milestones: DataFrame, on: str = "year") -> DataFrame:
    """questions(on, …) + latest milestone(on, ordinal, text) at or before it; '' when there is none.

    Milestones shrink to one per year and questions to their distinct years before the ordered step, then the
    answer comes back by an equi-join: a year that a third of all questions ask for is answered once.
    """
    last = milestones.groupBy(on).agg(F.max_by("text", "ordinal").alias("text"))
    asked = questions.select(on).distinct().join(last.select(on), on, "left_anti").withColumn("text", F.lit(None).cast("string"))
    axis = last_known(last.unionByName(asked), [], [on], F.col("text"), "milestone")
    return questions.join(axis.select(on, "milestone"), on, "left").withColumn(
        "milestone", F.coalesce("milestone", F.lit("")))


# Distance classes of a cross-check, in km.
MATCH_KM, CLOSE_KM = 0.1, 0.5


def geo_crosscheck(ours: DataFrame, theirs: DataFrame, key: str = "name") -> DataFrame:
    """Distance between our point and the authority's point of one facility, and how well they agree."""
    b = theirs.select(key, F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    rows = ours.join(b, key).withColumn("km", km)
    return rows.withColumn("agreement", F.when(F.col("km") < MATCH_KM, "matches").when(F.col("km") < CLOSE_KM, "close").otherwise("off"))


def patch_corrections(stations: DataFrame, corrections: DataFrame, key: str = "id") -> DataFrame:
    """corrections(id, corrections struct<lat, lng>, note) override the fields they give."""
    c = corrections.select(key, F.col("corrections.lat").alias("_lat"), F.col("corrections.lng").alias("_lng"))
    return stations.join(c, key, "left").withColumn("lat", F.coalesce("_lat", "lat")) \
        .withColumn("lng", F.coalesce("_lng", "lng")).drop("_lat", "_lng")


def split_codes(rows: DataFrame, column: str) -> DataFrame:
    """One row per structure code of a multi-valued code column."""
    return rows.withColumn("_c", F.explode(code_parts(F.col(column)))).select(*rows.columns, "_c.code", "_c.qualifier")


def code_breakdown(rows: DataFrame, column: str, owner: str, monitored: Column) -> DataFrame:
    """Features per code prefix and owner, and how many are monitored."""
    return rows.groupBy(code_prefix(F.col(column)).alias("prefix"), F.col(owner).alias("owner")).agg(
        F.count(F.lit(1)).alias("features"), F.count_if(monitored).alias("monitored"))


# Box of plausible coordinates, tolerated drift between attribute and geometry in km.
BOX, DRIFT_KM = (41.0, 43.0, -89.0, -87.0), 0.01


def coordinate_sanity(points: DataFrame) -> DataFrame:
    """points(id, lat, lng, attr_lat, attr_lng) → flags of implausible coordinates (empty = fine)."""
    lat, lng = F.col("lat"), F.col("lng")
    inside = lat.between(BOX[0], BOX[1]) & lng.between(BOX[2], BOX[3])
    drift = haversine_km(lat, lng, F.col("attr_lat"), F.col("attr_lng")) > DRIFT_KM
    flags = F.array_compact(F.array(
        F.when(F.col("attr_lat") == F.col("attr_lng"), "lat-equals-lng"), F.when(~inside, "outside-box"),
        F.when(drift, "attribute-drift")))
    return points.withColumn("flags", flags)
