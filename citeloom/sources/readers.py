"""Readers: JSON-lines logs, page folders, markdown folders, map layers, timelines, file listings, event CSVs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from citeloom import schemas

# What a corpus listing takes and leaves out.
CORPUS_EXTENSIONS = r"(?i)\.(pdf|txt|html|htm|md)$"
SKIPPED_FOLDERS = ("_new",)
SKIPPED_FILES = ("MANUAL-RETRIEVAL.md", ".DS_Store")


def _as_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)


def read_json_lines(spark: SparkSession, path: str, ddl: str, strict: bool = False) -> DataFrame:
    """One record per line. Strict reading fails on a malformed line, else such lines are skipped."""
    schema = _as_type(ddl)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _lenient(spark, path, schema).drop("_path")


def _lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Well-formed records of a JSON-lines folder, with their path.

    Lines are parsed by expression, since the JSON source refuses a count that needs only its malformed column.
    """
    broken = "_malformed"
    wide = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    parsed = lines.filter(F.trim("value") != "").select("_path", F.from_json(
        "value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}).alias("r"))
    return parsed.filter(F.col(f"r.{broken}").isNull()).select("_path", *[F.col(f"r.{f.name}") for f in schema.fields])


def _path_part(pattern: str, column: str = "_metadata.file_path") -> Column:
    return F.regexp_extract(F.url_decode(F.col(column)), pattern, 1)


def scan_pages(spark: SparkSession, folder: str, key_pattern: str = r"([^/]+)\.jsonl$", strict: bool = True) -> DataFrame:
    """Page records of a corpus; the file key is restored from the path."""
    schema = _as_type(schemas.PAGE)
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
        return rows.select(_path_part(key_pattern).alias("file"), "page", "method", "text")
    return _lenient(spark, folder, schema).select(
        _path_part(key_pattern, "_path").alias("file"), "page", "method", "text")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The append log of extraction."""
    return read_json_lines(spark, path, schemas.MANIFEST)


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.CHUNK, strict=True)


def scan_claim_logs(spark: SparkSession, claims: str, verdicts: str) -> tuple[DataFrame, DataFrame]:
    """Retrieved claims (a malformed line is fatal: it is the work list) and verdicts (such lines are skipped)."""
    return read_json_lines(spark, claims, schemas.CLAIM, strict=True), read_json_lines(spark, verdicts, schemas.VERDICT)


def scan_corpus_listing(spark: SparkSession, folder: str, pattern: str = CORPUS_EXTENSIONS) -> DataFrame:
    """Path and length of every corpus file below ``folder``; file contents are never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return listing.select("path", "length").filter(eligible(F.col("path"), pattern))


def eligible(path: Column, pattern: str = CORPUS_EXTENSIONS) -> Column:
    """Allowed extension, not a dot file, not a skipped name or folder."""
    name = F.element_at(F.split(path, "/"), -1)
    skipped = F.lit(False)
    for folder in SKIPPED_FOLDERS:
        skipped = skipped | F.contains(path, F.lit(f"/{folder}/"))
    return path.rlike(pattern) & ~name.startswith(".") & ~name.isin(*SKIPPED_FILES) & ~skipped


def scan_markdown_docs(spark: SparkSession, folder: str, slug_pattern: str = r"([^/]+)\.md$") -> DataFrame:
    """Whole markdown files with their slug."""
    docs = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return docs.select(_path_part(slug_pattern).alias("slug"), F.col("value").alias("text"))


def scan_json_layer(spark: SparkSession, path: str | None, member: str, ddl: str) -> DataFrame:
    """A map layer: a bare array of features, or an object that holds them under ``member``.

    A layer that is absent is an empty table of the same shape.
    """
    element = _as_type(ddl)
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], element)
    rows = spark.read.option("multiLine", "true").option("lineSep", "\x00").text(path, wholetext=True)
    bare = F.ltrim("value").startswith("[")
    strict = {"mode": "FAILFAST"}  # a file that is cut off fails, it does not look like an empty layer
    items = F.when(bare, F.from_json("value", T.ArrayType(element), strict)).otherwise(
        F.from_json("value", T.StructType([T.StructField(member, T.ArrayType(element))]), strict)[member]
    )
    return rows.select(F.explode(items).alias("f")).select("f.*")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scan_geojson_outfalls(spark: SparkSession, path: str) -> DataFrame:
    """Point features as named columns; stored axis order is [lng, lat], ours is lat, lng."""
    features = scan_json_layer(spark, path, "features", schemas.OUTFALL_FEATURE)
    point, props = F.col("geometry.coordinates"), F.col("properties")

    def text(name: str) -> Column:
        return F.coalesce(props[name], F.lit(""))

    return features.select(
        F.round(F.element_at(point, 2), 5).alias("lat"), F.round(F.element_at(point, 1), 5).alias("lng"),
        text("LOCATION").alias("location"), text("TARP_CONNECTION").alias("tarp"),
        text("OWNER").alias("owner"), text("WATERWAY_REACH").alias("reach"),
    )


def scan_timeline_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """``window.NAME = {...};`` wrappers → bundle name and nested document."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    body = F.regexp_replace("value", r"(?s)^\s*window\.[A-Za-z_]+\s*=\s*|;\s*$", "")
    return files.select(_path_part(r"([^/]+)\.(?:js|txt)$").alias("bundle"),
                        F.from_json(body, _as_type(schemas.TIMELINE), {"mode": "FAILFAST"}).alias("doc"))


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Discharge log CSV with raw and normalised columns; flags are a ';' list."""
    rows = spark.read.schema(_as_type(schemas.DISCHARGE)).option("header", "true").csv(path)
    return rows.withColumn("flags", F.filter(F.split(F.coalesce("flags", F.lit("")), ";"), lambda f: f != ""))
