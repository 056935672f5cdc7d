"""Importance resampling towards a target distribution over hashed runs of words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.llm.common import in_pieces, materialize, text_of

BUCKETS = 10_000
RUN = 2
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

# Fixed value: what stands between words after A-Z have been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Features:
    """Buckets of all runs of 1 to ``run`` consecutive words of an Arrow array of texts.

    ``bucket`` and ``doc`` hold one entry per feature, run length by run length; ``words`` counts each text's words.
    """

    def __init__(self, texts: pa.Array, buckets: int = BUCKETS, run: int = RUN):
        parts = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
        flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
        real = pc.not_equal(flat, "")
        encoded = pc.dictionary_encode(flat.filter(real))
        of = owner.filter(real).to_numpy(zero_copy_only=False).astype("int64")
        names = [w.encode() for w in encoded.dictionary.to_pylist()]
        word = encoded.indices.to_numpy(zero_copy_only=False).astype("int64")
        self.words = np.bincount(of, minlength=len(texts))
        # an entry of ``runs`` numbers a distinct run; ``crc`` holds each one's checksum
        runs, crc = word, np.array([zlib.crc32(w) for w in names], "int64")
        more = [b" " + w for w in names]
        found, docs = [(crc % buckets)[runs] if len(names) else runs], [of]
        for n in range(2, run + 1):
            inside = of[:len(of) - n + 1] == of[n - 1:]
            # the run before, shifted by one word, and the word that follows it
            key = runs[:len(inside)][inside] * max(1, len(names)) + word[n - 1:][inside]
            distinct, place = np.unique(key, return_inverse=True)
            crc = np.array([zlib.crc32(more[w], c) for c, w in zip(crc[distinct // max(1, len(names))].tolist(),
                                                                   (distinct % max(1, len(names))).tolist())], "int64")
            runs = np.zeros(len(inside), "int64")
            runs[inside] = place
            found.append((crc % buckets)[place] if len(distinct) else place)
            docs.append(of[:len(inside)][inside])
        self.bucket, self.doc = np.concatenate(found).astype("int64"), np.concatenate(docs)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> dict[int, int]:
    """How many features of all texts fall in each bucket; the result has at most ``buckets`` entries.

    A task adds up a vector of ``buckets`` counts and hands on what is not zero.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "int64")
        for batch in in_pieces(batches, 4 << 20):
            total += np.bincount(Features(batch.column(0), buckets, run).bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    parts = texts.select(text_of(text_col).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """Gain of each bucket: ``floor(scale * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(scale * math.log((float(target.get(b, 0) + 1) * all_raw) / (float(raw.get(b, 0) + 1) * all_target)))
                     for b in range(buckets)], "int64")


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of each document's features, 0 without any."""
    table = pa.array(gain, pa.int64())
    names = ["doc_id", "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 4 << 20):
            known = Features(batch.column(1), len(table), run)
            taken = table.take(pa.array(known.bucket)).to_numpy(zero_copy_only=False)
            features = np.bincount(known.doc, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, "int64")
            stretch, at = _stretches(known.doc)
            # a document has one stretch per run length
            np.add.at(total, stretch, np.add.reduceat(taken, at) if len(at) else taken)
            mean = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (known.words, features, mean))], names=names)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(weigh, ", ".join(f"{n} bigint" for n in names))


def _stretches(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners of the runs of equal values, and where each run begins."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, "int64")
    return owner[at], at


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise ``floor(-scale * ln(-ln((h + 0.5) / 2^32)))`` from a hash of the id; a null id is hashed as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT,
         score: Callable[[Column], Column] = noise) -> DataFrame:
    """``weighed`` plus ``score, rank``: the ``floor(percent * N / 100)`` best of the N documents with at least
    ``least_words`` words are ranked from 1, ties to the smaller id (null last); other ranks are null.

    Scores are whole numbers of limited range, so a count per score (a table of some ten thousand rows, whatever the
    corpus) tells how many documents come before each score; rows are ordered only within their score. Rows equal in
    all columns are counted before they are shuffled.
    """
    scored = materialize(weighed.withColumn("score", F.col("weight") + score(F.col("doc_id"))), "importance-scores")
    able = scored.filter(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    # scores are bounded by gains and noise, both logarithms of counts
    starts = F.broadcast(before.filter(F.col("before") < most).select("score", "before"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    equal = able.join(starts, "score").groupBy(*columns, "before").agg(F.count(F.lit(1)).alias("copies"))
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    every = placed.select(*columns, F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))).alias("rank"))
    ranked = every.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    beyond = scored.join(starts, "score", "left").filter((F.col("n_words") < least_words) | F.col("before").isNull())
    return ranked.unionByName(beyond.select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = BUCKETS, run: int = RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents drawn towards the distribution of ``target``: ``doc_id, n_words, n_features, weight, score, rank``.

    Texts are read twice, once to count the corpus and once to weigh each document; only numbers are shuffled.

    Nulls: a null text has no words; a null id is hashed as no digits and ranked after other ids of its score. Empty texts
    have weight 0 and no rank. Repeated rows are separate documents with successive ranks. Texts of any length are read
    whole. An empty table gives an empty result; an empty target is flat. Columns other than those named are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run), buckets)
    return draw(weights(docs, gain, id_col, text_col, run), least_words, percent)
