"""Dedup of repeated byte strings by a logarithmic family of suffix arrays over sampled suffixes.

Of each window of LENGTH bytes the suffix that starts at its smallest K-byte hash is sampled (a minimizer), so equal windows are
sampled at the same place and an index of the samples finds every repeated window. A batch of documents becomes a level: its
sampled suffixes, each with the text around it that its windows cover, dealt into buckets by the fingerprint of their first K bytes.
A new batch is merge-scanned against every level, bucket by bucket: the suffixes of both are sorted by their bytes into one suffix
array, neighbours with a common prefix of K bytes or more are runs, and the windows of a run are compared. Levels of equal size
merge, so a suffix is rewritten a logarithmic number of times. Suffixes that occur once are never shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_short, materialize, mix, n_parts, prefix_hash, span_hash, trim, union_all, vectorized
from .ngram_join import code_of, frequency_table, looked_up
from .spans import sha256

LENGTH, K = 100, 32
#: Suffixes that occur more often are compared window by window, by aggregations instead of in one bucket.
HOT = 20_000
#: Windows are searched in pieces of this many bytes, which bounds memory for very long texts.
PIECE = 1 << 22
_LEVEL = "route int, key bigint, doc bigint, sig bigint, lo bigint, hi bigint, left int, context binary"


def samples(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: its start, the prefix hash, and per sample its fingerprint, position, first and last window."""
    width = LENGTH - K + 1
    for base in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        data = np.frombuffer(raw[base : base + PIECE + LENGTH - 1], np.uint8)
        prefix = prefix_hash(data)
        at = np.arange(len(data) - K + 1)
        grams = span_hash(prefix, at, at + K)
        low = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        chosen = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        pos = chosen[first]
        # Smallest hashes crowd the low end of the hash space; mixed again they fill tables and buckets evenly.
        yield base, prefix, mix(grams[pos]), pos, first, last


def fingerprints(raw: bytes | None) -> np.ndarray:
    found = [s[2] for s in samples(raw or b"")]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _runs(doc: np.ndarray, sig: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, sig, first window, last window) of runs of consecutive windows."""
    if not len(doc):
        return doc, sig, at, at
    order = np.lexsort((at, sig, doc))
    doc, sig, at = doc[order], sig[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]) | (at[1:] > at[:-1] + 1)]))
    return doc[new], sig[new], at[new], at[np.append(new[1:], len(at)) - 1]


def _extractor(shared):
    """Rows of a batch: route 0 a sampled suffix with its context, 1 a window of a hot suffix, 2 windows that repeat earlier ones."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, hot = shared.value, int(code_of(HOT))
        for part in batches:
            # Where each context and window of the batch came first: a row that repeats doc_id and text meets its own place there.
            out, seen, windows = [], {}, {}
            for doc, sig, raw in sorted(zip(part["doc"], part["sig"], part["text"], strict=True), key=lambda x: x[:2]):
                for base, prefix, print_, pos, first, last in samples(raw or b""):
                    often = looked_up(table, print_)
                    for j in np.flatnonzero(often):
                        a, b, left = base + int(first[j]), base + int(last[j]), int(pos[j] - first[j])
                        if often[j] > hot:
                            start = np.arange(first[j], last[j] + 1)
                            for p, h in zip(start, span_hash(prefix, start, start + LENGTH).view(np.int64), strict=True):
                                place = (doc, sig, base + int(p))
                                before = windows.setdefault(int(h), place)
                                if before is place or before != place:
                                    out.append((1 if before is place else 2, int(h), *place, place[2], 0, None))
                            continue
                        context = raw[a : b + LENGTH]
                        place = (doc, sig, a)
                        before = seen.setdefault((left, context), place)
                        if before is place:
                            out.append((0, int(print_[j].view(np.int64)), *place, b, left, context))
                        elif before != place:
                            out.append((2, 0, *place, b, 0, None))
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _LEVEL.split(", ")])
                    out = []
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _LEVEL.split(", ")])
            del out, seen, windows
            trim()

    return extract


def suffix_runs(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The sampled suffixes of a bucket as a suffix array: in the order of their bytes from the sampled place on, and for each the number
    of the run of neighbours whose longest common prefix is K bytes or more. Suffixes alone in their run, and runs without a new one,
    are left out."""
    # A run's suffixes have one fingerprint: those whose fingerprint is alone, or no new one has, needn't be sorted.
    _, same, count = np.unique(group["key"].to_numpy(np.int64), return_inverse=True, return_counts=True)
    group = group[(count[same] > 1) & (np.bincount(same, weights=group["fresh"].to_numpy(bool))[same] > 0)]
    if not len(group):
        return group, np.empty(0, np.int64)
    suffix = [c[n:] for c, n in zip(group["context"], group["left"], strict=True)]
    order = np.array(sorted(range(len(suffix)), key=suffix.__getitem__))
    run = np.cumsum([0, *[suffix[x][:K] != suffix[y][:K] for x, y in zip(order, order[1:], strict=False)]])
    del suffix
    fresh = group["fresh"].to_numpy(bool)[order]
    size, new = np.bincount(run), np.bincount(run, weights=fresh)
    wanted = (size[run] > 1) & (new[run] > 0)
    return group.iloc[order[wanted]], run[wanted]


def _scan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Windows of the new rows of a bucket that start earlier in an old row or in another new one: the merged suffix array's runs are
    scanned, and inside a run windows are compared by their hashes."""
    group, run = suffix_runs(group)
    if not len(group):
        return pd.DataFrame({"doc": [], "sig": [], "lo": [], "hi": []}).astype("int64")
    text = b"".join(group["context"])
    size = group["context"].map(len).to_numpy(np.int64)
    count = size - LENGTH + 1
    row = np.repeat(np.arange(len(group)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + inner
    hashed = span_hash(prefix_hash(np.frombuffer(text, np.uint8)), start, start + LENGTH) ^ mix(run[row].astype(np.uint64) + np.uint64(1))
    doc, sig, at = group["doc"].to_numpy(np.int64)[row], group["sig"].to_numpy(np.int64)[row], group["lo"].to_numpy(np.int64)[row] + inner
    order = np.lexsort((at, sig, doc, hashed))
    h = hashed[order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    doc, sig, at = doc[order], sig[order], at[order]
    later = ((doc != doc[lead]) | (sig != sig[lead]) | (at != at[lead])) & group["fresh"].to_numpy(bool)[row][order]
    d, s, a, b = _runs(doc[later], sig[later], at[later])
    if key[0] % 16 == 0:
        trim()
    return pd.DataFrame({"doc": d, "sig": s, "lo": a, "hi": b})


class SuffixIndex:
    """Levels of sampled suffixes. add() takes batches in the order of doc_id and returns their repeated windows (doc, sig, lo, hi)."""

    def __init__(self, buckets: int):
        self.buckets, self.levels = buckets, []

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """``batch``: stored rows of route 0. The scan reads every level; keep=False leaves the batch out of the index."""
        bucket = F.pmod("key", F.lit(self.buckets)).alias("bucket")
        rows = lambda df, fresh: df.select(bucket, "key", "doc", "sig", "lo", "left", "context", F.lit(fresh).alias("fresh"))
        every = union_all([rows(batch, True), *[rows(x, False) for _, x in self.levels]])
        found = materialize(every.groupBy("bucket").applyInPandas(_scan, "doc long, sig long, lo long, hi long"), "repeats")
        if keep:
            self.levels.append((1, batch))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (n, a), (_, b) = self.levels.pop(), self.levels.pop()
                self.levels.append((2 * n, materialize(a.unionByName(b), "level")))
        return found


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, doc (doc_id, null as the smallest number) and sig (a hash of the text): doc and sig name a document."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"))
    return rows.withColumn("sig", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(doc, sig, lo, hi): runs of starts of LENGTH-byte windows that occur earlier, by (doc_id, hash of the text, start)."""
    spark = docs.sparkSession
    own = _named(docs).select("doc", "sig", "text").where(f"octet_length(text) >= {LENGTH}")
    shared = spark.sparkContext.broadcast(frequency_table(own, fingerprints))
    rows = materialize(own.mapInPandas(_extractor(shared), _LEVEL), "suffixes")
    shared.destroy()  # the suffixes are stored
    total = rows.where("route = 0").agg(F.count(F.lit(1)), F.min("doc"), F.max("doc")).first()
    index = SuffixIndex(max(n_parts(spark) * 4, total[0] // 2000 + 1))
    found, low, high = [], total[1] or 0, total[2] or 0
    # Batches double from the second on, as levels do: half of the documents meet the index once.
    edges = [low, *[low + (high - low + 1) * 2**b // 2 ** (batches - 1) for b in range(batches)]]
    for b in range(batches if total[0] else 0):
        inside = (F.col("route") == 0) & (F.col("doc") >= edges[b]) & (F.col("doc") < edges[b + 1])
        found.append(index.add(rows.where(inside), keep=b < batches - 1))
    hot = rows.where("route = 1").select("key", "doc", "sig", "lo")
    first = hot.groupBy("key").agg(F.min(F.struct("doc", "sig", "lo")).alias("first"))
    again = hot.join(first, "key").where("not (doc = first.doc and sig = first.sig and lo = first.lo)").select("doc", "sig", "lo", F.col("lo").alias("hi"))
    return union_all([rows.where("route = 2").select("doc", "sig", "lo", "hi"), again, *found])


@vectorized("struct<n_removed:bigint,n_spans:bigint,kept_sha256:string>")
def _cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, own in zip(texts, runs, strict=True):
        raw = raw or b""
        if own is None or not len(own):
            rows.append((0, 0, sha256(raw)))
            continue
        edge = np.zeros(len(raw) + 1, np.int64)
        np.add.at(edge, [r["lo"] for r in own], 1)
        np.add.at(edge, [r["hi"] + LENGTH for r in own], -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        rows.append((int(gone.sum()), spans, sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, batches: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes, null is empty; texts of fewer than LENGTH bytes keep all. A null doc_id comes before all others.
    Rows that repeat doc_id and text are one document, all cut alike; rows of one doc_id (or none) with different texts are
    documents of their own, in the order of the texts' hashes. Other columns are ignored.
    """
    runs = repeated_windows(docs, batches).groupBy("doc", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    runs = if_short(materialize(runs, "runs"), "runs", 300_000)
    joined = _named(docs).join(runs, ["doc", "sig"], "left").withColumn("c", _cut("text", "runs"))
    return joined.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "c.*")
