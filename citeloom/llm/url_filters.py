"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citeloom.llm.common import let, wrapped
from citeloom.llm.labelled_urls import ALLOW, BLOCK

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = 1 << 14
GRAM = 4
MAX_LABELLED = 4000  # labelled urls that training reads at most, half of them per label
MAX_RULES = 1000     # rules become one expression, so their number is bounded


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path``; both empty without a ``://`` or for a null url."""
    at = F.instr(F.col(url_col), "://")
    rest = F.coalesce(F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def rule_of(rules: tuple[Rule, ...], part: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits ``host`` and ``path``, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        chosen = F.when(host & F.col("path").startswith(rule.path), F.lit(getattr(rule, part))).otherwise(chosen)
    return chosen


def grams() -> Column:
    """Character n-grams of host and path, each kind marked, with ends marked so that short parts count too."""
    def of(part: str, mark: str) -> Column:
        framed = F.concat(F.lit("^"), F.col(part), F.lit("$"))
        return let(F.split(framed, ""), lambda chars: F.when(F.size(chars) >= GRAM, F.transform(
            F.sequence(F.lit(1), F.size(chars) - (GRAM - 1)),
            lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, GRAM), "")))).otherwise(
            F.array(F.concat(F.lit(mark), framed))))

    return F.concat(of("host", "h"), of("path", "p"))


def train(labelled: DataFrame, features: int = FEATURES, most: int = MAX_LABELLED) -> PipelineModel | None:
    """Fit on ``labelled(host, path, label)``; label 1 means block.

    ``most`` bounds the table that is read for training: half of it per label, the rows of smallest hash. The bounded
    sample is put in one partition in a fixed order, so the same table gives the same model. Without any labelled url there
    is no model (None).
    """
    sample = None
    for label in (0, 1):
        part = labelled.filter(F.col("label") == label).select("host", "path", F.lit(float(label)).alias("label")).orderBy(
            F.xxhash64("host", "path"), "host", "path").limit(most // 2)
        sample = part if sample is None else sample.unionByName(part)
    sample = sample.coalesce(1).withColumn("grams", grams())
    if sample.isEmpty():
        return None
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    fitted = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.001, maxIter=50, standardization=False).fit(
        hashing.transform(sample))
    return PipelineModel([hashing, fitted])


def judge(pages: DataFrame, model: PipelineModel | None, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_score``.

    The longest fitting rule decides; where none fits, the model does: block at a score of 0.5 or more (0 without a model). Every row is
    judged in place, without a shuffle; the model's weights are the only thing sent to the tasks and their number is
    fixed by ``train``.

    A null url, or one without ``://``, has an empty host and path and gets the model's verdict on those. Repeated rows
    give repeated rows, long urls are used whole, an empty table gives an empty result, other columns pass through
    (columns named like the added ones are replaced).
    """
    rows = with_parts(wrapped(pages, url=F.col(url_col))).withColumns({
        "rule": rule_of(rules, "text"), "ruled": rule_of(rules, "verdict"), "grams": grams()})
    score = vector_to_array("probability")[1] if model else F.lit(0.0)
    scored = (model.transform(rows) if model else rows).withColumn("block_score", score)
    decided = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    return scored.withColumn("verdict", decided).select(*kept, "host", "path", "rule", "verdict", "block_score")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled url table of this subpackage: ``host, path, label``, 1 for urls to block."""
    rows = [(u, label) for label, urls in ((1, BLOCK), (0, ALLOW)) for u in urls]
    return with_parts(spark.createDataFrame(rows, "url string, label int"), "url").select("host", "path", "label")


def ruled_labels(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """A labelled url table out of the pages that a rule decides: ``host, path, label``."""
    return with_parts(pages.select(url_col), url_col).withColumn("_v", rule_of(rules, "verdict")).filter(
        F.col("_v").isNotNull()).select("host", "path", (F.col("_v") == "block").cast("int").alias("label"))
