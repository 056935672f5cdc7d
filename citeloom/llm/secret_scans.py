"""Secret scanning: fixed patterns plus sliding-window entropy over candidate strings, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.llm.common import let, text_of, wrapped

# The base patterns and the shortest value each keeps. A run of at least k characters of a class is the
# same span whether short runs are dropped afterwards or left unmatched, so the two run patterns state k themselves.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character class, the pattern of its candidates, its alphabet, and the entropy in bits from which a window counts.
CLASSES = (
    ("hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 3.0),
    ("base64", r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8),
)
#: Candidates that are no secrets though they may look random: words and paths in one case, plain numbers, identifiers
#: in the 8-4-4-4-12 form, and keys that documentation marks as examples.
ALLOWED = (
    r"[A-Z]?[a-z/_+-]+", r"[A-Z/_+-]+", r"[0-9/_+-]+",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", r".*EXAMPLE.*",
)

SPAN = "struct<start:int,rank:int,end:int>"


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as array<struct<start,end,match>> in code points, end exclusive.

    The text between matches and the matches themselves alternate, so running lengths give the positions.
    """
    steps = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                   lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))),
        lambda s: s["match"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))
    found = F.aggregate(steps, zero, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + F.length(s["match"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["match"])).alias("end"),
            s["match"].alias("match")))).alias("out")), lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)"))


def _ranked(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind: array<struct<start,rank,end>>."""
    assign = F.filter(find_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.sort_array(F.concat(_ranked(assign, "assign"), _ranked(find_spans(text, ACCESS), "access"),
                                 _ranked(find_spans(text, HEX), "hex")))


def _weight(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def hot_stretch(candidate: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """struct<first,last>: where the first window at or above ``bits`` starts and the last one ends; first -1 if none.

    One pass over the characters keeps the count of each character in the window and the sum of c * log2 c. A step
    takes the leaving character off and adds the entering one, which changes two counts and two terms of the sum.
    The entropy of a full window is log2 w - sum / w.
    """
    chars = F.split(candidate, "")
    steps = F.filter(F.zip_with(chars, F.concat(F.array_repeat(F.lit(""), window), chars),
                                lambda a, b: F.struct(a.alias("new"), b.alias("old"))), lambda s: s["new"].isNotNull())
    places = F.transform(steps, lambda s, i: F.struct(
        i.alias("i"), F.instr(F.lit(alphabet), s["new"]).alias("new"),
        F.when(s["old"] == "", F.lit(0)).otherwise(F.instr(F.lit(alphabet), s["old"])).alias("old")))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
                    F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["old"] > 0, F.get(acc["counts"], s["old"] - 1)).otherwise(F.lit(0))
        entering = F.get(acc["counts"], s["new"] - 1) - F.when(s["old"] == s["new"], 1).otherwise(0)
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == s["new"] - 1, 1).otherwise(0) - F.when(j == s["old"] - 1, 1).otherwise(0))
        total = acc["sum"] - _weight(out) + _weight(out - 1) + _weight(entering + 1) - _weight(entering)
        full = s["i"] >= window - 1
        return let(F.struct(total.alias("sum"), counts.alias("counts")), lambda now: let(
            full & (F.log2(F.lit(window)) - now["sum"] / window >= bits),
            lambda hot: F.struct(
                now["counts"].alias("counts"), now["sum"].alias("sum"),
                F.when(hot & (acc["first"] < 0), s["i"] - (window - 1)).otherwise(acc["first"]).alias("first"),
                F.when(hot, s["i"] + 1).otherwise(acc["last"]).alias("last"))))

    return F.aggregate(places, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, classes=CLASSES, allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW) -> Column:
    """Stretches of high entropy, one at most per candidate and class: array<struct<start,rank,end>>."""
    suppressed = "(?s)^(?:" + "|".join(allowed) + ")$" if allowed else "(?!)"

    def of_class(pattern: str, alphabet: str, bits: float) -> Column:
        def placed(s: Column) -> Column:
            return let(hot_stretch(s["match"], alphabet, bits, window), lambda h: F.struct(
                (s["start"] + h["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"),
                F.when(h["first"] < 0, F.lit(-1)).otherwise(s["start"] + h["last"]).alias("end")))

        rough = F.filter(find_spans(text, pattern), lambda s: ~s["match"].rlike(suppressed))
        return F.filter(F.transform(rough, placed), lambda s: s["end"] >= 0)

    parts = [of_class(*c[1:]) for c in classes]
    return F.array_distinct(F.concat(*parts))


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: array<struct<start,rank,end>> by start, then kind (``KINDS[rank]``), in code points.

    Base kinds are always kept. The method adds spans of kind entropy; one that lies inside a base span, or whose
    candidate stands on the allow-list, is left out. All work happens in the row, without a shuffle.

    A null text is empty and has no spans. Repeated rows give repeated rows, texts may be of any length, an empty table
    gives an empty result, and other columns pass through (``out`` is replaced if it exists).
    """
    text = text_of(text_col)
    both = let(text, lambda t: let(base_spans(t), lambda base: F.sort_array(F.concat(base, F.filter(
        entropy_spans(t), lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))))))
    return docs.withColumn(out, both)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; spans that touch or overlap become one mark.

    Texts without spans, null ones among them, stay as they are. Columns keep their names and order.
    """
    found = scan(wrapped(docs, text=F.col(text_col)), "text", "secrets")
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("secrets", zero, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when((s["start"] > acc["at"]) | (acc["at"] == 0), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("secrets") > 0, cut).otherwise(text)
    return found.withColumn("text", clean).select(*[
        F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
