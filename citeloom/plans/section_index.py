"""A field-weighted index of sections, written once: blocks of impacts and an ordered dictionary with each word's weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from citeloom.functions.text import index_tokens
from citeloom.operators import impact_blocks as I
from citeloom.operators.sections import BOOSTS, RESULTS, prefix_words
from citeloom.plans.keyword_index import word_counts
from citeloom.session import materialize, small_side

FEW_PREFIXES = 500  # asked at once as ranges of the ordered dictionary; more are met by reading it


@dataclass(frozen=True)
class SectionIndex:
    root: str


def build(index: SectionIndex, records: DataFrame) -> None:
    """records(id, section, doc, text): every field is cut into words once. A word of a field is a word of the index, the
    field's number in front, so that each has its own document frequency; a section's fields stand in one range."""
    rows = materialize(records.select("id", F.array(*[word_counts(F.coalesce(F.col(name), F.lit(""))) for name in BOOSTS]).alias("fields")).withColumn(
        "lengths", F.transform("fields", lambda f: F.aggregate(f, F.lit(0), lambda n, w: n + w["tf"]))), "section-words")
    order = range(len(BOOSTS))
    found = rows.agg(F.count(F.lit(1)), *[F.avg(F.get("lengths", F.lit(i))) for i in order]).first()
    n_docs, means = found[0], [float(m or 0) or 1.0 for m in found[1:]]
    own = F.aggregate("lengths", F.lit(0), lambda n, x: n + x)
    # rows of a repeated id stand together
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.sum(own).cast("int").alias("_dl")).filter("_n > 1").select("id", "_dl")
    rows = rows.join(small_side(materialize(repeated, "section-repeated")), "id", "left").withColumn("dl", F.coalesce("_dl", own))
    ranges = I.Ranges.of(rows)
    mean = F.array(*map(F.lit, means))
    fields = rows.select("id", ranges.place(F.col("id"), F.col("dl")).alias("range"), "lengths", F.posexplode("fields").alias("field", "found")).select(
        "id", "range", I.length_norm(F.get("lengths", F.col("field")), F.get(mean, F.col("field"))).alias("norm"),
        F.transform("found", lambda w: F.struct(F.concat(F.col("field").cast("string"), w["term"]).alias("term"), w["tf"].alias("tf"))).alias("words"))
    I.write_blocks(fields, ranges, f"{index.root}/blocks", summed=True)
    boost = F.get(F.array(*map(F.lit, BOOSTS.values())), F.substring("term", 1, 1).cast("int"))
    I.write_dictionary(_blocks(index, records), f"{index.root}/words")
    words = records.sparkSession.read.schema("term string, df bigint").parquet(f"{index.root}/words")
    words.select("term", (boost * I.idf(F.col("df").cast("double"), n_docs)).alias("weight")).write.mode("overwrite").parquet(f"{index.root}/terms")


def _blocks(index: SectionIndex, like: DataFrame) -> DataFrame:
    schema = "part int, range int, term string, n bigint, cf bigint, top double, rows array<struct<id: string, impact: double>>"
    return like.sparkSession.read.schema(schema).parquet(f"{index.root}/blocks")


def _per_field(words: DataFrame) -> DataFrame:
    """words(qid, term, times) with a row per field, as the index names its words."""
    fields = F.array(*[F.lit(str(i)) for i in range(len(BOOSTS))])
    return words.select("qid", F.explode(F.transform(fields, lambda f: F.concat(f, "term"))).alias("term"), "times")


def _starting_with(missed: DataFrame, terms: DataFrame) -> DataFrame:
    """missed(qid, term, times) → the dictionary's words that begin with theirs. Words are in order, so a prefix is a range:
    a few prefixes become conditions that the reader checks against the bounds of each stretch of the file."""
    prefixes = [r[0] for r in missed.select("term").distinct().limit(FEW_PREFIXES + 1).collect()]
    if not prefixes:
        return missed.limit(0)
    if len(prefixes) <= FEW_PREFIXES:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("term").startswith(p)
        terms = terms.filter(hit)
    return prefix_words(missed, terms)


def search(index: SectionIndex, queries: DataFrame, k: int = RESULTS) -> DataFrame:
    """queries(qid, text) → qid, id, score, rank0: best ``k`` sections per question.

    Questions none of whose words occur anywhere fall back to words that start with theirs.
    """
    words = queries.select("qid", F.explode(index_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(
        F.count(F.lit(1)).cast("double").alias("times"))
    words = materialize(_per_field(words), "section-asked")
    terms = queries.sparkSession.read.schema("term string, weight double").parquet(f"{index.root}/terms")
    known = materialize(words.join(terms.select("term"), "term", "left_semi").select("qid", "term", "times"), "section-known")
    missed = words.join(known.select("qid").distinct(), "qid", "left_anti")
    asked = known.unionByName(_starting_with(missed, terms.select("term")).select("qid", "term", "times"))
    weighted = asked.join(terms, "term").select("qid", "term", (F.col("times") * F.col("weight")).alias("weight"))
    return I.block_topk(weighted, _blocks(index, queries), queries.count(), k)
