"""Benchmark decontamination by winnowing: both sides keep the smallest k-gram hash of each sliding window, equal fingerprints
are extended to the full shared run, and every shared run of ``span`` words is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, prefix_hash, separators, small_batches, span_hash, trim, vectorized, word_spans
from .spans import sha256

#: Bytes between words: all of ASCII but digits and (lower-cased) letters.
BREAKS = separators([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_RESULT = "struct<n_words:bigint,runs:array<bigint>,items:array<string>>"


def fingerprints(words: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps: any ``span`` equal consecutive words share at least one."""
    grams = gram_hashes(words, k)
    width = span - k + 1
    if len(grams) < width:
        return grams[:0], np.empty(0, np.int64)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(len(grams) - width + 1))
    return grams[at], at


def spans_hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw.lower(), np.uint8)
    start, end = word_spans(data, BREAKS)
    return start, end, span_hash(prefix_hash(data), start, end) if len(start) else np.empty(0, np.uint64)


class Index:
    """The fingerprints of one block of items. Items of fewer than ``span`` words have one window, kept by its own length."""

    def __init__(self, items: list[tuple[str, bytes]], span: int, k: int):
        self.span, self.k, self.ids, self.words = span, k, [i for i, _ in items], [spans_hashed(t)[2] for _, t in items]
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for t, words in enumerate(self.words):
            if len(words) >= span:
                found, at = fingerprints(words, span, k)
                rows.setdefault(0, []).append((found, np.full(len(found), t), at))
            elif len(words):
                rows.setdefault(len(words), []).append((gram_hashes(words, len(words)), np.array([t]), np.array([0])))
        self.tables = {}
        for length, parts in rows.items():
            found, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(found, kind="stable")
            self.tables[length] = found[order], item[order], at[order]

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of document words inside occurring windows, and the items that these are of."""
        runs, items, done = [], set(), set()
        for length, (known, item, where) in self.tables.items():
            found, at = (gram_hashes(words, length), None) if length else fingerprints(words, self.span, self.k)
            low = np.searchsorted(known, found)
            high = np.searchsorted(known, found, "right")
            for i in np.flatnonzero(high > low):
                for j in range(low[i], high[i]):
                    t, shift = int(item[j]), int(i if at is None else at[i]) - int(where[j])
                    if (t, shift) not in done:
                        done.add((t, shift))
                        new = self._extended(words, t, shift, length or self.span)
                        runs += new
                        if new:
                            items.add(t)
        return runs, items

    def _extended(self, words: np.ndarray, t: int, shift: int, least: int) -> list[tuple[int, int]]:
        """The runs of ``least`` or more equal words where item ``t`` lies on the document from word ``shift`` on."""
        own = self.words[t]
        a, b = max(0, -shift), min(len(own), len(words) - shift)
        same = np.zeros(b - a + 2, np.int8)
        same[1:-1] = own[a:b] == words[a + shift : b + shift]
        step = np.diff(same)
        return [(int(x) + a + shift, int(y) + a + shift) for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True) if y - x >= least]


def _searcher(shared):
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for part in texts:
            out = []
            for raw in part:
                words = spans_hashed(raw or b"")[2]
                runs, found = index.hits(words)
                out.append((len(words), [x for r in runs for x in r], [index.ids[t] for t in sorted(found)]))
            yield pd.DataFrame(out, columns=["n_words", "runs", "items"])
            del out
            trim()

    # A filter on a deterministic function is pushed below its projection, which computes it twice, in further Python workers.
    return F.pandas_udf(search, _RESULT).asNondeterministic()


def with_hits(docs: DataFrame, items: DataFrame, into: str, span: int = 13, k: int = 8, block_bytes: int = 16 << 20, text: str = "text") -> DataFrame:
    """``docs`` and, for each block of items, a struct column ``into``_0, ``into``_1, ... of what it hits.

    The items are a stated query set: it is cut into blocks of about ``block_bytes`` of text, which bounds what the driver reads
    and broadcasts at a time, and each block meets every document. Documents are never shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast((sorted((r["item"] or "", bytes(r["text"])) for r in rows), span, k))

        docs = docs.withColumn(f"{into}_{b}", _searcher(shared)(F.col(text).cast("binary")))
    columns = [F.col(f"{into}_{b}") for b in range(blocks)]
    merged = F.struct(columns[0]["n_words"].alias("n_words"), F.flatten(F.array(*[c["runs"] for c in columns])).alias("runs"), F.flatten(F.array(*[c["items"] for c in columns])).alias("items"))
    return docs.withColumn(into, merged).drop(*[f"{into}_{b}" for b in range(blocks)])


def _covered(n: int, runs) -> np.ndarray:
    hit = np.zeros(n, bool)
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        hit[a:b] = True
    return hit


@vectorized("struct<n_hit:bigint,n_items:bigint,items_sha256:string>")
def _summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(int(_covered(n, r).sum()), len(i), sha256(",".join(sorted(i)))) for n, r, i in zip(part["n_words"], part["runs"], part["items"], strict=True)]
        yield pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256"])


def _without(raw: bytes, n: int, runs) -> bytes:
    """A text without its hit words; what stands between two hit words goes with them."""
    start, end, _ = spans_hashed(raw)
    hit = _covered(n, runs)
    keep = np.ones(len(raw), bool)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        keep[start[a] : end[b - 1]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes()


def _cleaner():
    def clean(texts: pd.Series, hits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for raw, n, runs in zip(texts, hits["n_words"], hits["runs"], strict=True):
            hit = int(_covered(n, runs).sum())
            gone = hit > 0 and 20 * hit >= n
            rows.append((gone, _without(raw, n, runs) if hit and not gone else None))
        return pd.DataFrame(rows, columns=["gone", "cut"])

    return F.pandas_udf(clean, "struct<gone:boolean,cut:binary>").asNondeterministic()


CONTAMINATED = "__s.n_hit > 0 and 20 * __s.n_hit >= __h.n_words"


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Null and empty texts have no
    words; items without words hit nothing; an item without an id counts under the empty one; repeated items count each, repeated documents are each reported; other columns
    are ignored. Empty tables give an empty or an all-clean result.
    """
    found = with_hits(docs.select("doc_id", "text"), items, "__h", span, k).drop("text").withColumn("__s", _summed("__h"))
    return found.select("doc_id", "__h.n_words", "__s.n_hit", "__s.n_items", "__s.items_sha256", F.expr(CONTAMINATED).alias("contaminated"), F.col("__h.items").alias("items"))


def without_leaks(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 8) -> DataFrame:
    """``docs`` without contaminated rows; hit words of the others are cut from their texts, and n_chars, where present, is counted anew.

    Columns stay, whatever their names; nulls stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = with_hits(rows, items, "hit", span, k).withColumn("cleaned", _cleaner()(F.col("text").cast("binary"), "hit")).where("not cleaned.gone")
    found = found.select("row", F.coalesce(F.col("cleaned.cut").cast("string"), F.col("text")).alias("kept"))
    put = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
