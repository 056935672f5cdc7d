"""Markdown documents → sections, and field-weighted search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions.text import (
    document_title, heading_anchor, index_length, index_tokens, markdown_clean, strip_bibliography, strip_space,
)
from citeloom.operators.retrieval import bm25_weight, keyword_topk
from citeloom.session import materialize

# Field weights, result count.
BOOSTS = {"section": 5.0, "doc": 3.0, "text": 1.0}
RESULTS = 40

_HEADING = r"(?md)^#{2,3}\s+(.+)$"
_OPEN, _CLOSE = "\x1d", "\x1f"


def section_array(text: Column) -> Column:
    """Intro and sections of a document in order as array of struct(heading, content); the intro has no heading."""
    marked = F.regexp_replace(strip_bibliography(text), _HEADING, f"{_OPEN}$1{_CLOSE}")
    return F.transform(F.split(marked, _OPEN), lambda p, i: F.struct(
        F.when(i > 0, strip_space(F.substring_index(p, _CLOSE, 1))).alias("heading"),
        F.when(i > 0, F.regexp_replace(p, f"(?s)^[^{_CLOSE}]*{_CLOSE}", "")).otherwise(p).alias("content")))


def sections(docs: DataFrame, least_intro: int = 1, least_section: int = 0, cut: int | None = None) -> DataFrame:
    """docs(slug, text) → slug, ordinal, id, doc, section, url, text. Pairing happens inside the row, without a shuffle.

    Ids repeat when headings repeat; the ordinal tells them apart. Texts are whole and sections of any length are kept;
    intros shorter than ``least_intro`` and sections shorter than ``least_section`` go, texts are cut to ``cut`` if asked.
    """
    url = F.concat(F.when(F.col("slug").startswith("00"), "").otherwise("docs/"), "slug", F.lit(".html"))
    # Cleaning inside the array keeps it out of reach of filter push-down, which would clean each section again.
    cleaned = F.transform(section_array(F.col("text")), lambda s: F.struct(
        s["heading"].alias("heading"), markdown_clean(s["content"]).alias("body")))
    rows = docs.select("slug", document_title(F.col("text"), F.col("slug")).alias("doc"), url.alias("page"),
                       F.posexplode_outer(cleaned).alias("ordinal", "s"))
    rows = rows.select("slug", "doc", "page", "ordinal", "s.heading", "s.body")
    is_intro = F.col("heading").isNull()
    anchor = heading_anchor(F.col("heading"))
    kept = rows.filter(F.when(is_intro, F.length("body") >= least_intro).otherwise(F.length("body") >= least_section))
    return kept.select(
        "slug", "ordinal",
        F.when(is_intro, F.concat("slug", F.lit("#top"))).otherwise(F.concat("slug", F.lit("#"), anchor)).alias("id"), "doc",
        F.when(is_intro, "Overview").otherwise(markdown_clean(F.col("heading"))).alias("section"),
        F.when(is_intro, F.col("page")).otherwise(F.concat("page", F.lit("#"), anchor)).alias("url"),
        (F.col("body") if cut is None else F.substring("body", 1, cut)).alias("text"))


def field_weights(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """records(id, section, doc, text) → id, term, weight: per-field keyword weights times boost, summed.

    All fields go through one pass: a record becomes one row per field, statistics are per field.
    """
    fields = records.select("id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(boost).alias("boost"), index_tokens(F.col(name)).alias("words"))
        for name, boost in BOOSTS.items()])).alias("f")).select("id", "f.*", F.size("f.words").alias("dl"))
    means = records.agg(F.count(F.lit(1)).cast("double").alias("n_docs"),
                        *[F.avg(index_length(F.col(name))).alias(name) for name in BOOSTS])
    stats = means.select("n_docs", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(name).alias("avg_dl")) for name in BOOSTS])).alias("s")).select("n_docs", "s.*")
    words = fields.select("id", "field", "boost", "dl", F.explode_outer("words").alias("term")) \
        .join(vocabulary.select("term").distinct(), "term", "left_semi")
    post = words.groupBy("id", "field", "boost", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).cast("double").alias("df"))
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avg_dl")) * F.col("boost")
    return post.join(df, ["field", "term"]).join(stats, "field").groupBy("id", "term").agg(F.sum(weight).alias("weight"))


def prefix_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace each word by the dictionary terms that start with it.

    Terms are matched by equality on as many characters as some word has, so a term gives a row per asked length and
    none for other lengths; no term is compared with every word.
    """
    lengths = words.select(F.length("term").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))
    asked = F.coalesce(lengths.scalar(), F.array().cast("array<int>"))
    sized = dictionary.select("term", asked.alias("ns"))
    heads = sized.select("term", F.explode(F.filter("ns", lambda n: n <= F.length("term"))).alias("n")).select(
        F.expr("substring(term, 1, n)").alias("head"), "term")
    return words.select("qid", F.col("term").alias("head"), "times").join(heads, "head").groupBy("qid", "term").agg(
        F.sum("times").alias("times"))


def section_search(queries: DataFrame, records: DataFrame, k: int = RESULTS) -> DataFrame:
    """queries(qid, text), records(id, section, doc, text) → best ``k`` per query.

    Queries none of whose words occur anywhere fall back to words that start with theirs.
    """
    words = queries.select("qid", F.explode(index_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(
        F.count(F.lit(1)).cast("double").alias("times"))
    tokens = index_tokens(F.concat_ws(" ", "section", "doc", "text"))
    # Both are read several times below; they are index tables, far smaller than the records.
    dictionary = materialize(records.select(F.explode_outer(tokens).alias("term")).distinct().filter("term IS NOT NULL"), "dictionary")
    known = words.join(dictionary, "term", "left_semi")
    missed = words.join(known.select("qid").distinct(), "qid", "left_anti")
    asked = materialize(known.unionByName(prefix_words(missed, dictionary)), "asked")
    return keyword_topk(asked, field_weights(records, asked), records.count(), queries.count(), k)
