"""Approximate nearest items: cluster cells prune candidates, then exact scores inside the probed cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from citeloom.operators.retrieval import (
    SLICE_ROWS, VECTOR_BLOCK_ROWS, _bucket, _distances, _hit_schemas, _matrix, _points, rank_hits, vector_kernel,
)


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length one, as doubles."""
    as_double = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x * x))
    # the norm is worked out once a vector, not once a component
    return vectors.withColumn("vector", F.transform(F.array(norm), lambda n: F.transform(as_double, lambda x: x / F.greatest(n, F.lit(1e-300))))[0])


def fit_cells(items: DataFrame, cells: int, seed: int = 7, max_iter: int = 10) -> KMeansModel:
    """Cluster centres of items(id, vector). Centres steer the search only; every item stays in the result set."""
    ready = unit(items).select(array_to_vector("vector").alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=max_iter).fit(ready)


def vector_topk_ann(queries: DataFrame, items: DataFrame, k: int, model: KMeansModel, probes: int = 4) -> DataFrame:
    """Best ``k`` of the items in the ``probes`` cells nearest to each query.

    A crowded cell (one that holds a third of all items, say) is cut into sub-slices by item hash, as many as
    its own count asks for, so no co-group grows with the data.
    """
    schema, arrow = _hit_schemas(queries, items)
    # vectors travel as they came; only the features are scaled
    assigned = model.transform(unit(items.withColumn("given", F.col("vector"))).withColumn("features", array_to_vector("vector"))).select(
        "id", F.col("given").alias("vector"), F.col("prediction").alias("cell"))
    widths = assigned.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SLICE_ROWS), F.lit(1)).cast("int").alias("width"))
    probed = _probed(queries.select("qid", "vector"), np.array(model.clusterCenters(), np.float64), probes)
    blocks = max(1, math.ceil(queries.count() / VECTOR_BLOCK_ROWS))
    left = probed.join(widths, "cell").select(
        "qid", "vector", "cell", _bucket("qid", blocks).alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("slice"))
    right = assigned.join(widths, "cell").select(
        F.col("id").alias("item"), F.col("vector").alias("item_vector"), "cell",
        F.pmod(F.xxhash64("id"), F.col("width")).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ("cell", "block", "slice")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(vector_kernel(k, "cosine", arrow), schema)
    return rank_hits(hits, k)


def _probed(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """qid, vector, cell: each query with its ``probes`` nearest centres, which are sent to the tasks as one matrix."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = queries.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(_distances(_points(_matrix(pa.chunked_array([batch.column("vector")])), "cosine"), shared.value), axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                cell = pa.array(near.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*(x.take(row) for x in batch.columns), cell], arrow)], schema=arrow)

    return queries.mapInArrow(run, schema)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, per query."""
    hit = found.select("qid", "id", F.lit(1).alias("hit"))
    return exact.select("qid", "id").join(hit, ["qid", "id"], "left").groupBy("qid").agg(
        (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
