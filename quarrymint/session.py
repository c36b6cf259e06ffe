"""Session helpers: the shared scratch folder, lineage cuts through written tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only while its row count times its row width stays under this many bytes.
BROADCAST_BYTES = 32 << 20

_written: list[tuple[SparkSession, str]] = []


#: A key with at least this share of the rows is hot; its rows are spread over so many parts in a join.
HOT_SHARE, SALTS = 1 / 256, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder in
    local mode, and an error on a cluster, whose machines would each write to a folder of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrymint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quarrymint/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str, partition_by: list[str] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there and any executor can reread it.
    ``counts`` are aggregates that the same pass takes; the result's ``counted`` has them."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation() if counts else None
    if seen:
        df = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrymint_path = path
    out.counted = seen.get if seen else {}
    return out


def drop(df: DataFrame) -> None:
    """Delete the written table behind a frame returned by :func:`cut`, once a later one has replaced it."""
    path = getattr(df, "_quarrymint_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch space
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark._sc._jsc is not None:
            _delete(spark, path)


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``broadcast(df)`` if its known row count keeps it under :data:`BROADCAST_BYTES`, else ``df`` for a join by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def hot_values(df: DataFrame, key: Column) -> list:
    """The values of ``key`` (a number or text) that hold at least HOT_SHARE of the rows, null aside. They come from one
    mergeable sketch of bounded size, so no key is shuffled; a few more than asked for may be listed."""
    most = int(1 / HOT_SHARE)
    row = df.select(key.alias("k")).where(F.col("k").isNotNull()).agg(F.expr(f"approx_top_k(k, {most}, {16 * most})").alias("top"), F.count("*").alias("n")).first()
    least = max(2.0, row["n"] * HOT_SHARE)
    return [r["item"] for r in row["top"] or [] if r["count"] >= least]


def join_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def skew_join(many: DataFrame, one: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``many.join(one, keys, how)`` (inner or left) by a shuffle on the keys, where a hot key's rows of ``many`` go to
    SALTS parts by the hash of ``spread`` and the rows of ``one`` for it are copied to each. ``hot`` gives the hot values of
    ``join_hash(keys)`` where they are known from elsewhere; they decide where rows go, never which rows come out."""
    h = join_hash(keys)
    hot = hot_values(many, h) if hot is None else hot
    if not hot:
        return many.join(one.hint("merge"), list(keys), how)
    is_hot = h.isin(hot)
    left = many.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("__salt", F.explode(copies))
    return left.join(right.hint("merge"), [*keys, "__salt"], how).drop("__salt")
