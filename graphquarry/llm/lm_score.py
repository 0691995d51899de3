"""Masked pseudo-likelihood: a network trained in numpy predicts each token from both sides, and the sum of the conditional
log-probabilities scores a document.

The vocabulary is counted over the whole corpus. Frequent words are classes of their own, all others fall into classes by their
hash. Every position of every document is counted into (left class, right class, middle class) cells, a table bounded by the
classes, and the network is trained on all cells by their counts. A word's probability is its class's, given both neighbours, times
its own share of its class. The most frequent words go to the workers with their exact counts; the others of a document are joined with
the vocabulary, so that every word has its exact count. A table of a byte for each slot of the hash space, eight steps a doubling, that
grows with the vocabulary (four slots a word, up to 2**SLOTS) tells which words come once and need no join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, trim, words_hashed

#: Classes: one beyond the text's ends, OWN words of their own, the rest by hash.
CLASSES, OWN = 64, 40
#: The table of counts has 2**12 to 2**26 slots. Words may share a slot, whose count is then the sum of theirs: they are joined.
SLOTS = 12, 26
#: So many words at most, the most frequent, go to the workers with their counts.
FREQUENT = 1 << 20


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word hash, count) of every distinct word of the corpus; A-Z count as lower case."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            raw = b" ".join(x or b"" for x in part["text"])
            word, n = np.unique(words_hashed(raw), return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Word hashes to classes: the OWN most frequent words by a table, the others by their hash."""

    def __init__(self, own: list[int]):
        order = np.argsort(np.array(own, np.int64).view(np.uint64)) if own else np.empty(0, np.int64)
        self.known = np.array(own, np.int64).view(np.uint64)[order]
        self.cls = (order + 1).astype(np.int64)

    def of(self, words: np.ndarray) -> np.ndarray:
        out = (1 + OWN + (mix(words) % np.uint64(CLASSES - 1 - OWN))).astype(np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            same = self.known[at] == words
            out[same] = self.cls[at[same]]
        return out


def _cells(cls: np.ndarray) -> np.ndarray:
    """left * C * C + right * C + middle of each position; 0 stands beyond the ends."""
    edge = np.concatenate([[0], cls, [0]])
    return (edge[:-2] * CLASSES + edge[2:]) * CLASSES + cls


class Network:
    """Embeddings of both neighbours, one hidden layer, a softmax over classes; full-batch Adam on weighted cells."""

    def __init__(self, counts: np.ndarray, dim: int = 16, hidden: int = 32, steps: int = 120, rate: float = 0.05, seed: int = 5):
        rng, c = np.random.default_rng(seed), CLASSES
        n = counts.reshape(c * c, c).astype(float)
        total = max(n.sum(), 1.0)
        p = {"l": rng.normal(0, 0.3, (c, dim)), "r": rng.normal(0, 0.3, (c, dim)), "w": rng.normal(0, 0.3, (2 * dim, hidden)), "b": np.zeros(hidden), "o": rng.normal(0, 0.1, (hidden, c)), "z": np.log((n.sum(0) + 1) / (total + c))}
        left, right = np.divmod(np.arange(c * c), c)
        weight = n.sum(1, keepdims=True)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        for step in range(1, steps + 1):
            x, h, prob = self._forward(p, left, right)
            d = (prob * weight - n) / total
            back = (d @ p["o"].T) * (1 - h * h)
            dx = back @ p["w"].T
            grad = {"o": h.T @ d, "z": d.sum(0), "w": x.T @ back, "b": back.sum(0), "l": dx[:, :dim].reshape(c, c, dim).sum(1), "r": dx[:, dim:].reshape(c, c, dim).sum(0)}
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] = p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.log_p = np.log(self._forward(p, left, right)[2] + 1e-12).astype(np.float32).ravel()

    @staticmethod
    def _forward(p, left, right):
        x = np.concatenate([p["l"][left], p["r"][right]], axis=1)
        h = np.tanh(x @ p["w"] + p["b"])
        s = h @ p["o"] + p["z"]
        e = np.exp(s - s.max(1, keepdims=True))
        return x, h, e / e.sum(1, keepdims=True)


def _counter(shared):
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, total = Classes(shared.value), np.zeros(CLASSES**3, np.int64)
        for part in batches:
            found = [_cells(classes.of(words_hashed(raw))) for raw in part["text"] if raw]
            if found:
                total += np.bincount(np.concatenate(found), minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    return cells


def count_table(words: DataFrame) -> bytes:
    """A byte for each slot of the leading bits of a word's hash: 0 where no word falls, else 1 + 8 * log2 of how often its words come.

    The table is made in parts of the hash space, compressed, and read by the driver a part at a time.
    """
    distinct = words.count()
    width = int(min(SLOTS[1], max(SLOTS[0], np.ceil(np.log2(4 * distinct + 1)))))
    low = width - min(10, width)

    def part(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        slot = (group["word"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - width)).astype(np.int64) & ((1 << low) - 1)
        n = np.bincount(slot, weights=group["n"].to_numpy(float), minlength=1 << low)
        codes = np.where(n > 0, np.minimum(255, 1 + np.round(8 * np.log2(np.maximum(n, 1)))), 0).astype(np.uint8)
        return pd.DataFrame({"part": [int(key[0])], "codes": [zlib.compress(codes.tobytes(), 1)]})

    parts = words.withColumn("part", F.shiftrightunsigned("word", 64 - width + low).cast("int")).groupBy("part").applyInPandas(part, "part int, codes binary")
    table = np.zeros(1 << width, np.uint8)
    for r in materialize(parts, "counts").toLocalIterator():
        table[r["part"] << low : (r["part"] + 1) << low] = np.frombuffer(zlib.decompress(r["codes"]), np.uint8)
    return table.tobytes()


def log_counts(raw: bytes, words: np.ndarray) -> np.ndarray:
    """Natural logarithms of how often words come, from the table; a word that isn't in it counts once."""
    table = np.frombuffer(raw, np.uint8)
    code = table[(words >> np.uint64(64 - len(table).bit_length() + 1)).astype(np.int64)].astype(np.float32)
    return np.maximum(code - 1, 0) * np.float32(np.log(2) / 8)


def least_count(words: DataFrame) -> int:
    """The smallest count from which on there are FREQUENT words at most."""
    least, held = None, 0
    for n, times in sorted(words.groupBy("n").count().collect(), reverse=True):
        held += times
        if held > FREQUENT:
            return n + 1
        least = n
    return least or 1


def _scorer(shared):
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, log_p, total, frequent, logs, table = shared.value
        classes, frequent, logs = Classes(own), np.frombuffer(frequent, np.uint64), np.frombuffer(logs, np.float64)
        for part in texts:
            out = []
            for raw in part:
                words = words_hashed(raw or b"")
                cls = classes.of(words)
                # A class of one word is the word; in others a word has its own share.
                plain = cls > OWN
                rest, share = words[plain], -total[cls[plain]].sum()
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, rest), len(frequent) - 1)
                    same = frequent[at] == rest
                    share, rest = share + logs[at[same]].sum(), rest[~same]
                rest = rest[log_counts(table, rest) > 0] if table else rest[:0]
                out.append((len(cls), float(log_p[_cells(cls)].astype(np.float64).sum() + share) if len(cls) else 0.0, rest.view(np.int64)))
            yield pd.DataFrame(out, columns=["n_tokens", "log_prob", "rest"])
            trim()

    return F.pandas_udf(score, "struct<n_tokens:bigint,log_prob:double,rest:array<bigint>>")


def pseudo_likelihood(docs: DataFrame, seed: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, log_prob (summed), per_token (log_prob / n_tokens; null without words).

    Null and empty texts have no tokens and a sum of 0. Repeated rows count each and are each scored. To the driver go the
    FREQUENT most frequent words, how many words have each count, each class's total, the CLASSES**3 cells at most, and the table of
    counts, 2**SLOTS[1] bytes at most. How large these are changes what is joined, not the scores.
    """
    spark = docs.sparkSession
    words = materialize(vocabulary(docs), "words")
    own = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    shared = spark.sparkContext.broadcast(own)
    cells = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(_counter(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3, np.int64)
    for r in cells.collect():
        counts[r["cell"]] = r["n"]
    def class_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(shared.value)
        for part in batches:
            yield pd.DataFrame({"cls": classes.of(part["word"].to_numpy(np.int64).view(np.uint64)), "n": part["n"].to_numpy(float)})

    total = np.zeros(CLASSES)
    for r in words.mapInPandas(class_of, "cls long, n double").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        total[r["cls"]] = np.log(r["n"])
    least = least_count(words)
    top = words.where(F.col("n") >= least).select("word", "n").toArrow()
    word = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    # Where no other word comes twice, none has to be joined.
    table = count_table(words) if least > 2 else b""
    model = spark.sparkContext.broadcast((own, Network(counts, seed=seed).log_p, total, word[order].tobytes(), np.log(top["n"].to_numpy()[order]).tobytes(), table))
    scored = docs.select("doc_id", _scorer(model)(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")
    if table:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        others = words.where((F.col("n") < least) & (F.col("n") > 1))
        # Sums of whole numbers don't depend on the order of rows.
        more = scored.select("row", F.explode("rest").alias("word")).join(others, "word").groupBy("row").agg(F.sum(F.round(F.log("n") * 1e10).cast("long")).alias("more"))
        scored = scored.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0)) / 1e10)
    return scored.select("doc_id", "n_tokens", F.round("log_prob", 4).alias("log_prob"), F.round(F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")), 6).alias("per_token"))
