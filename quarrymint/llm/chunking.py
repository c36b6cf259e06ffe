"""Splitting oversized texts at natural boundaries with overlap, all greedy cuts by pointer doubling (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymint.llm.tokens import VOCABULARY, encoder, small_batches, spread, token_bytes

#: Kinds of boundary, best first: before this place ends a paragraph, a line, a sentence, a word; else any whole character.
KINDS = ("paragraph", "line", "sentence", "word", "character", "end")
#: A better boundary is taken only if it leaves the piece at least so full.
MIN_FILL = 0.5
#: Least limit: a piece must hold a few characters of several tokens each.
LEAST_LIMIT = 32


def boundaries(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each token start (byte offset) the index in KINDS of the boundary there; 9 inside a character."""
    n = len(raw)
    ok = at < n
    here = np.where(ok, raw[np.minimum(at, n - 1)], 32)
    before = np.where(at > 0, raw[np.maximum(at - 1, 0)], 10)
    before2 = np.where(at > 1, raw[np.maximum(at - 2, 0)], 10)
    space = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    kind = np.full(len(at), 4, dtype=np.int8)
    kind[space(here) | space(before)] = 3
    kind[np.isin(before, (46, 33, 63)) & space(here)] = 2
    kind[np.isin(before2, (46, 33, 63)) & (before == 32)] = 2
    kind[before == 10] = 1
    kind[(before == 10) & (here == 10)] = 1
    kind[(before == 10) & (before2 == 10)] = 0
    kind[ok & ((here & 0xC0) == 0x80)] = 9
    return kind


def greedy_cuts(kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, as token numbers, of the pieces of a text with the boundaries ``kind`` (one more than tokens).

    Every boundary is first joined to its farthest legal successor: the last boundary of the best kind such that the
    piece, which starts ``overlap`` tokens before, holds at most ``limit`` tokens. The successor table is then squared
    again and again; after r squarings the first 2^r cuts are known, so all cuts come in log2(cuts) vectorized steps.
    """
    n = len(kind) - 1
    whole = np.flatnonzero(kind != 9)
    places = np.arange(n + 1)
    start = whole[np.maximum(np.searchsorted(whole, np.maximum(places - overlap, 0), side="right") - 1, 0)]
    succ = np.full(n + 1, -1)
    reach = np.minimum(start + limit, n)
    succ[reach == n] = n
    for k in range(5):
        found = np.flatnonzero(kind <= k)
        if not len(found):
            continue
        last = found[np.maximum(np.searchsorted(found, reach, side="right") - 1, 0)]
        least = 0 if k == 4 else MIN_FILL * limit
        take = (succ < 0) & (last > places) & (last - start >= least) & (last <= reach)
        succ[take] = last[take]
    stuck = succ < 0  # only where limit - overlap is less than one character's tokens: the next whole character
    nxt = whole[np.minimum(np.searchsorted(whole, places + 1), len(whole) - 1)]
    succ[stuck] = nxt[stuck]
    cuts, table = np.array([0]), succ
    while cuts[-1] != n:
        cuts = np.concatenate([cuts, table[cuts]])
        if cuts[-1] != n:
            table = table[table]
    cuts = cuts[: int(np.argmax(cuts == n)) + 1] if n else cuts
    return start[cuts[:-1]], cuts[1:]


def split_text(text: str, limit: int, overlap: int, path: str = VOCABULARY) -> list[tuple]:
    """Pieces (text, start and end character, tokens, tokens shared with the piece before, kind of the cut at its end).

    Each piece is tokenized again by itself; should one exceed the limit because its edges tokenize differently when
    alone, the text is cut again under a limit less by the excess."""
    e, sizes = encoder(path), token_bytes(path)
    ids = np.array(e.encode_ordinary(text), dtype=np.int64)
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes[ids])])
    kind = boundaries(raw, at)
    kind[-1] = 0
    room = limit
    while True:
        starts, ends = greedy_cuts(kind, room, min(overlap, room // 2))
        texts = [data[at[a] : at[b]].decode() for a, b in zip(starts, ends, strict=True)]
        counts = [len(e.encode_ordinary(t)) for t in texts]
        most = max(counts)
        if most <= limit:
            break
        room = max(1, room - (most - limit))  # at 1 every piece is a token or a character
    out, last_end = [], 0
    first = 0
    chars = np.cumsum((raw & 0xC0) != 0x80)
    pos = lambda b: int(chars[b - 1]) if b else 0
    for t, c, a, b in zip(texts, counts, starts, ends, strict=True):
        out.append((t, pos(at[a]), pos(at[b]), c, int(last_end - a) if first else 0, KINDS[5] if b == len(ids) else KINDS[kind[b]]))
        last_end, first = b, 1
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, path: str = VOCABULARY) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens; texts within the limit give no rows.

    Columns: ``key`` and piece_no (from 1), piece, start_char, end_char, n_tokens, overlap_tokens, cut (kind of the
    boundary that ends it). Pieces hold at most ``limit`` tokens, cover the text in order, and each but the first starts
    ``overlap`` tokens before the end of the one before (up to 3 more, so that no character is cut). Null and empty texts
    give no rows; a repeated row gives its pieces again. Nothing is shuffled but the input's own rows, to spread them.
    A byte-level tokenizer never has more tokens than the text has bytes, so texts of at most ``limit`` bytes are
    filtered out in the scan's stage, before Python. A limit under LEAST_LIMIT, or an overlap that is negative or more than
    half of the limit, is an error.
    """
    if limit < LEAST_LIMIT or not 0 <= overlap <= limit // 2:
        raise ValueError(f"the limit must be at least {LEAST_LIMIT}, the overlap at most half of it")

    def cut_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for part in parts:
            rows = []
            for k, t in zip(part["k"], part["t"], strict=True):
                if len(e.encode_ordinary(t)) > limit:
                    rows.extend((k, i + 1, *p) for i, p in enumerate(split_text(t, limit, overlap, path)))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["k", "piece_no", "piece", "start_char", "end_char", "n_tokens", "overlap_tokens", "cut"]
    kind = df.schema[key].dataType.simpleString()
    picked = small_batches(df).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where(F.octet_length("t") > limit)
    out = spread(picked, df.sparkSession.sparkContext.defaultParallelism).mapInPandas(
        cut_up, f"k {kind}, piece_no long, piece string, start_char long, end_char long, n_tokens long, overlap_tokens long, cut string"
    )
    taken = set(names[1:])
    return out.withColumnRenamed("k", key if key not in taken else f"{key}_")
