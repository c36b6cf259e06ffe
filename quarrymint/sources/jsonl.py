"""JSON Lines sources and sinks: strict, tolerant, with provenance, gated by a schema version; logs and evidence bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymint.operators.ranking import numbered


def read_strict(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Every non-blank line must be an object of the schema; a bad line fails the job."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "value")
    checked = parsed.where(F.when(F.trim("value").startswith("{"), True).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))).cast("boolean")))
    return checked.select("r.*")


def split_valid(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` with ``kind`` of each: object, other (valid JSON, but no object), invalid or blank."""
    text = F.col(column)
    v = F.try_parse_json(text)
    kind = F.when(text.isNull() | (F.trim(text) == ""), "blank").when(v.isNull(), "invalid").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("other")
    return lines.withColumn("kind", kind)


def read_commented(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines in which lines that begin with # are comments."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_versioned(spark: SparkSession, path: str, schema: T.StructType | str, version: str) -> DataFrame:
    """A strict scan in which every row must carry the schema version."""
    rows = read_strict(spark, path, schema)
    ok = F.col("schema_version").eqNullSafe(F.lit(version))
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"schema_version is not {version}")).cast("boolean")))


def with_provenance(df: DataFrame, source: str, order: str) -> DataFrame:
    """Line number within the source, from 1, for sources of any length."""
    return numbered(df, [source], [F.col(order)], "line_number")


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """Rows in a total order, fields in name order, nulls left out; ranges of the order become files, so no one task has
    all rows. ``mode`` append makes a log."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*cols)).alias("value")).write.mode(mode).text(path)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def source_tree(spark: SparkSession, path: str, pattern: str = "*.py", excluded: Sequence[str] = (".git", "__pycache__", ".venv", "node_modules")) -> DataFrame:
    """Text files below a folder, files in excluded folders and files that are no UTF-8 left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    keep = ~F.arrays_overlap(parts, F.array(*[F.lit(e) for e in excluded])) & F.is_valid_utf8(F.col("content").cast("string"))
    return files.where(keep).select("path", F.col("content").cast("string").alias("source"), F.col("length").alias("bytes"))
