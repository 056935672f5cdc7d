"""Layer tables → one categorised feature table, and its state in a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citeloom.functions.geo import layer_category
from citeloom.operators import geo as G


def feature_table(layers: dict[str, DataFrame]) -> DataFrame:
    """Union of layers with their display category; the layer name is the group."""
    rows = G.union_layers(layers)
    for name in ("type", "kind", "id"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumn("category", layer_category(F.col("layer"), F.col("type"), F.col("kind"), F.col("id").cast("string")))


def state_at(features: DataFrame, flows: DataFrame, milestones: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """What stands in ``year`` with its flow direction, and the milestone shown for it."""
    standing = G.visible(features, year)
    moving = G.flow_at(standing.filter(F.col("geometry").isNotNull()), flows, F.lit(year)).select("layer", "id", "forward")
    shown = G.milestone_asof(features.sparkSession.range(1).select(F.lit(year).alias("year")), milestones)
    return standing.join(moving, ["layer", "id"], "left"), shown
