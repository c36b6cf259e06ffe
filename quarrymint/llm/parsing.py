"""Source files that are no complete, valid file of their language (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymint.llm.grammar.languages import EXTENSIONS, parses
from quarrymint.llm.tokens import small_batches
from quarrymint.session import cut, skew_join

#: Rows a core from which on the texts fill enough partitions by their size alone.
TASK_ROWS = 50_000


def check_sources(df: DataFrame, key: str, path: str, sides: Sequence[tuple[str, str]], carry: Sequence[str] = ()) -> DataFrame:
    """``key``, side, language, the ``carry`` columns and ``valid`` for each source of a known language.

    ``sides`` names the source columns: (label, column). The extension of ``path``, in any letter case, gives the
    language; files of other languages, without a path, and sources that are null or blank give no rows. Rows that come
    again give their verdict again.

    Method: copies of a text are one text (by 128 bits of its hash), so each is parsed once and whole: tokens, then the
    generalised LL recogniser, all dialects of the language together, then the rules of the language that no context-free
    grammar says. The verdict comes from these alone. Only the hashes of the texts found invalid go back to the rows; a
    text with very many copies is combined in the map tasks, and its rows are spread when its verdict comes back.
    """
    suffix = F.lower(F.regexp_extract(F.col(f"`{path}`"), r"\.([^./\\]+)$", 1))
    texts = F.array(*[F.struct(F.lit(label).alias("side"), F.col(f"`{c}`").alias("text")) for label, c in sides])
    picked = df.select(F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)], suffix.alias("language"), texts.alias("t")).where(F.col("language").isin(*EXTENSIONS))
    extra = [f"x{i}" for i in range(len(carry))]
    rows = picked.select("k", *extra, "language", F.explode("t").alias("t")).select("k", *extra, "language", "t.side", "t.text").where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    rows = rows.withColumn("h1", F.xxhash64("language", "text")).withColumn("h2", F.xxhash64("text", F.lit(5)))
    marked = cut(rows.drop("text"), "parsing-rows", counts={"rows": F.count(F.lit(1))})

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            wrong = [not parses(language, t) for language, t in zip(part["language"], part["text"], strict=True)]
            yield part.loc[wrong, ["h1", "h2"]]

    once = rows.groupBy("h1", "h2").agg(F.first("language").alias("language"), F.first("text").alias("text"))
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if marked.counted["rows"] < tasks * TASK_ROWS:  # so few texts would be put into a few partitions by their bytes
        once = once.repartition(2 * tasks)
    wrong = small_batches(once).mapInPandas(judge, "h1 long, h2 long")
    wrong = cut(wrong, "parsing-invalid").withColumn("wrong", F.lit(True))
    out = skew_join(marked, wrong, ["h1", "h2"], F.concat_ws("-", F.col("k").cast("string"), "side"), "left")
    taken = {"side", "language", "valid"}
    free = lambda c: c if c not in taken else f"{c}_"
    valid = F.col("wrong").isNull().alias("valid")
    return out.select(F.col("k").alias(free(key)), "side", "language", *[F.col(f"x{i}").alias(free(c)) for i, c in enumerate(carry)], valid)


def rates(checked: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Sources, invalid sources and their rate for each group; a (key, side) that comes again counts once. Only keys and
    flags are shuffled, and counts are summed in the map tasks first."""
    once = checked.select(key, "side", *[F.col(f"`{c}`") for c in by], "valid").dropDuplicates([key, "side"])
    out = once.groupBy(*by).agg(F.count("*").alias("sources"), F.count_if(~F.col("valid")).alias("invalid"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("sources"), 6))


