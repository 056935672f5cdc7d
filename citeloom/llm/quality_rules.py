"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.llm.common import SPACE, SPACE_CHARS, let, materialize, text_of
from citeloom.session import small_side

RUN = 8  # words in a window
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """An adaptive bound: a quantile of the group plus ``reach`` times the group's spread and a fixed ``slack``.

    ``low`` and ``high`` are the quantiles whose distance is the spread; ``upper`` says on which side the bound lies;
    ``most`` is the largest bound, for metrics that end at 10,000.
    """

    metric: str
    low: float
    high: float
    reach: float
    slack: int
    upper: bool
    most: int | None = None


GRAIN = 1 / 16  # a sketch bucket is a sixteenth wide, so no spread is taken to be less than that part of ``high``

#: Metrics are whole numbers: hundredths of a character, or rows per ten thousand. Both quantiles lie among the other
#: documents while junk makes up to a third of a group, which thus does not move the bound; for a normal metric 11 times
#: the middle 30 % reaches beyond four deviations. What more than a third of a group shows is usual there.
FENCES = (
    Fence("word_length", 0.35, 0.65, 11.0, 100, True),
    Fence("word_length", 0.35, 0.65, 11.0, 50, False),
    Fence("symbols", 0.35, 0.65, 11.0, 1000, True),
    Fence("dup_lines", 0.35, 0.65, 11.0, 5000, True, 9000),
    Fence("repeats", 0.35, 0.65, 11.0, 2500, True, 9000),
)
MIN_DOCS = 200  # of a group whose own bounds hold


def _repeated(words: Column) -> Column:
    """Words inside ``RUN``-word windows that occur twice or more, the first occurrence included."""
    def cover(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ordered, lambda t: F.filter(F.transform(t, lambda w, k: F.when(
            F.coalesce(F.get(t, k - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(t, k + 1)["h"] == w["h"], F.lit(False)),
            w["i"])), lambda i: i.isNotNull()))
        return F.aggregate(F.sort_array(places), F.struct(F.lit(0).alias("end"), F.lit(0).alias("all")), lambda acc, i: F.struct(
            (i + RUN).alias("end"), (acc["all"] + i + RUN - F.greatest(i, acc["end"])).alias("all")), lambda acc: acc["all"])

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (RUN - 1)), lambda i: F.xxhash64(F.slice(hashes, i, RUN)))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), cover(w)).otherwise(F.lit(0))))
    return F.when(F.size(words) > RUN, counted).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words> of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    rows = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return let(F.struct(counts.alias("c"), rows.alias("r")), lambda z: F.struct(
        z["c"]["n_words"].cast("bigint").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        z["r"]["n_lines"].cast("bigint").alias("n_lines"),
        z["r"]["n_dup_lines"].cast("bigint").alias("n_dup_lines"),
        z["c"]["n_repeat_words"].cast("bigint").alias("n_repeat_words"),
    ))


def metrics() -> dict[str, Column]:
    """The compared numbers, from the columns of ``measures``; null where a document has no words."""
    def per(value: str, whole: str, unit: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(value) * unit / F.col(whole)).cast("bigint"))

    return {
        "word_length": per("word_chars", "n_words", 100),
        "symbols": per("n_symbols", "n_words", 10_000),
        "dup_lines": per("n_dup_lines", "n_lines", 10_000),
        "repeats": per("n_repeat_words", "n_words", 10_000),
    }


def bucket(value: Column) -> Column:
    """Sketch bucket: values below 32 have their own, each doubling above is cut into 16, so it is 6 % wide at most."""
    power = F.length(F.bin(value)) - 1
    return F.when(value < 32, value).otherwise(
        32 + (power - 5) * 16 + F.pmod(F.floor(value / F.pow(F.lit(2.0), power - 4)).cast("bigint"), F.lit(16))).cast("int")


def bucket_top(number: Column) -> Column:
    """The largest value of a bucket."""
    power = F.floor((number - 32) / 16) + 5
    return F.when(number < 32, number).otherwise(
        (F.pmod(number - 32, F.lit(16)) + 17) * F.pow(F.lit(2.0), power - 4) - 1).cast("bigint")


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketch per group and metric as counts of buckets: ``*keys, metric, bucket, n``. Counts simply add, so a
    sketch is built before the shuffle, and those of groups add up to that of any larger group."""
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket")) for name, value in metrics().items()])
    return measured.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.metric", "_e.bucket").filter(
        F.col("bucket").isNotNull()).groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(cells: DataFrame, keys: list[str], fences: tuple[Fence, ...]) -> DataFrame:
    """Bounds from sketches: ``*keys, _docs, _bounds`` with a bound per fence."""
    group = [*keys, "metric"]
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = sorted({q for f in fences for q in (f.low, f.high)})
    placed = cells.withColumns({"_upto": F.sum("n").over(running), "_all": F.sum("n").over(Window.partitionBy(*group))})
    found = placed.groupBy(*group).agg(
        F.max("_all").alias("_docs"),
        *[bucket_top(F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col("bucket")))).alias(f"_q{i}") for i, q in enumerate(wanted)])
    bounds = []
    for f in fences:
        low, high = (F.col(f"_q{wanted.index(q)}") for q in (f.low, f.high))
        reach = f.reach * F.greatest(high - low, high * GRAIN) + f.slack
        bound = (high + reach) if f.upper else (low - reach)
        bounds.append(F.max(F.when(F.col("metric") == f.metric, bound if f.most is None else F.least(bound, F.lit(float(f.most))))))
    return found.groupBy(*keys).agg(F.max("_docs").alias("_docs"), F.array(*bounds).alias("_bounds"))


def thresholds(measured: DataFrame, fences: tuple[Fence, ...] = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row per language and source, with a bound per fence: ``_tl, _ts, _bounds``. Groups of fewer than ``min_docs``
    documents take the bounds of their language's merged sketch, and languages that small those of all documents."""
    cells = materialize(sketch(measured, ["lang", "source"]), "quality-sketch")
    by_lang = cells.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    own = _quantiles(cells, ["lang", "source"], fences)
    lang = _quantiles(by_lang, ["lang"], fences).select(F.col("lang").alias("_l"), F.col("_docs").alias("_ld"), F.col("_bounds").alias("_lb"))
    every = _quantiles(overall.withColumn("_one", F.lit(1)), ["_one"], fences).select(F.lit(1).alias("_o"), F.col("_bounds").alias("_ob"))
    return own.join(lang, F.col("lang").eqNullSafe(F.col("_l")), "left").withColumn("_one", F.lit(1)).join(
        every, F.col("_one") == F.col("_o"), "left").select(
        F.col("lang").alias("_tl"), F.col("source").alias("_ts"),
        F.when(F.col("_docs") >= min_docs, F.col("_bounds")).when(F.col("_ld") >= min_docs, F.col("_lb")).otherwise(F.col("_ob")).alias("_bounds"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       F.xxhash64(text).alias("_text_key"), let(text, measures).alias("_m"), *more)
    return materialize(rows.select(*[c for c in rows.columns if c != "_m"], "_m.*"), "quality-measures")


def _verdicts(measured: DataFrame, fences: tuple[Fence, ...], min_docs: int) -> DataFrame:
    """``measured`` with ``base_failed, kept``; the bounds, a row per language and source, are sent to the rows."""
    bounds = small_side(materialize(thresholds(measured, fences, min_docs), "quality-bounds"))
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("_tl")) & F.col("source").eqNullSafe(F.col("_ts")), "left")
    values = metrics()
    outside = F.lit(False)
    for i, fence in enumerate(fences):
        bound = F.get("_bounds", F.lit(i))
        value = values[fence.metric]
        outside = outside | F.coalesce(value > bound if fence.upper else value < bound, F.lit(False))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & ~outside).alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          fences: tuple[Fence, ...] = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """A verdict per document: ``doc_id, lang, source, _text_key``, the measures, ``base_failed, kept``.

    Texts are measured once, in the row; a narrow table of the measures is written. Its sketches give every language
    and source bounds of its own; small groups borrow those of their language, small languages those of all. A document is kept if the base rules pass and each metric lies within its group's bounds.
    Thresholds adapt: a source in which symbols are usual tolerates more of them; junk in up to a third of it loosens none.

    Nulls: a null text has no words and fails; null languages and sources are groups of their own; a null id is kept.
    Repeated rows give repeated rows. An empty table gives an empty result. Other columns are not read.
    """
    return _verdicts(_measured(docs, id_col, text_col, lang_col, source_col), fences, min_docs)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                   fences: tuple[Fence, ...] = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that pass, unchanged. Each row is written once beside its measures, and decided where it lies."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _verdicts(_measured(docs, id_col, text_col, lang_col, source_col, whole), fences, min_docs).filter("kept").select("row.*")
