"""Text functions as columns: normalization, tokens, n-grams, overlaps, diff counts, line parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """Lower case, outer white space gone, inner runs one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Double stars, carets and runs of a-z, 0-9, _ in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\*\*|\^|[a-z0-9_]+)"), F.lit(1))


def ngrams(words: Column, n: int, gap: int = 1) -> Column:
    """Runs of n words (with ``gap`` 2 or more, pairs that far apart), joined by a space."""
    span = (n - 1) * gap
    steps = F.when(F.size(words) > span, F.sequence(F.lit(1), F.size(words) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.concat_ws(" ", *[F.element_at(words, (i + j * gap).cast("int")) for j in range(n)]))


def char_ngrams(c: Column, n: int) -> Column:
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    steps = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.substr(padded, i, F.lit(n)))


#: Words that carry no meaning of their own (fixed values).
STOP = ("a", "an", "and", "or", "the", "to")


def lexical_tokens(c: Column) -> Column:
    """The distinct words of a text without stop words, each with its variants, in order: y for ies, without a final s,
    without ing, and both forms of what begins with validat. Null and empty texts have none."""
    words = F.regexp_extract_all(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOP))

    def forms(w: Column) -> Column:
        n, validates = F.length(w), w.startswith("validat")
        return F.array(
            w,
            F.when((n > 3) & w.endswith("ies"), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("y"))),
            F.when((n > 3) & w.endswith("s"), F.substr(w, F.lit(1), n - 1)),
            F.when((n > 5) & w.endswith("ing"), F.substr(w, F.lit(1), n - 3)),
            F.when(validates, "validate"),
            F.when(validates, "validation"),
        )

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(kept, forms)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), 6)


def diff_counts(diff: Column) -> tuple[Column, Column]:
    """Added and removed lines of a unified diff, its file headers left out."""
    lines = F.split(diff, "\n")
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return added, removed


def bucket(n: Column) -> Column:
    """Count buckets 0, 1, 2_3, 4_7, 8_plus."""
    return F.when(n.isNull(), None).when(n <= 0, "0").when(n == 1, "1").when(n <= 3, "2_3").when(n <= 7, "4_7").otherwise("8_plus")
