"""Quality rules by weak supervision: rules vote or abstain, EM estimates how reliable each is, and the posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CODES, materialize, small_batches, trim, vectorized

#: The rules in the order of a vote string: B bad, G good, - abstains.
RULES = ("symbols", "upper", "exclaims", "repeats", "dup_lines", "variety", "word_length", "prose", "function_words")
METRICS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,votes:string>"
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 2, bool)
    again = count[inverse] > 1
    for j in range(3):
        hit[j : n + j] |= again
    return int(hit.sum())


def _vote(bad: bool, good: bool = False) -> str:
    return "B" if bad else "G" if good else "-"


def measure(raw: bytes | None) -> tuple:
    """The metrics of one text and its vote string."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(count.sum() - count[128:192].sum() - count[list(SPACE_CODES)].sum())
    symbols = int(count[_SYMBOLS].sum())
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeats = _repeated(ids, len(index))
    if not n:
        return 0, chars, symbols, dup, repeats, "-" * len(RULES)
    upper, letters = count[65:91].sum(), count[65:91].sum() + count[97:123].sum()
    top = np.bincount(ids).max() / n
    per = lambda codes: count[[ord(c) for c in codes]].sum() / n
    short = sum(len(w) <= 3 for w in words) / n
    votes = (
        _vote(symbols > 0.2 * n),
        _vote(letters > 20 and upper > 0.4 * letters),
        _vote(per("!?") > 0.3),
        _vote(n >= 20 and repeats > 0.3 * n),
        _vote(lines >= 4 and dup > 0.5 * lines),
        _vote(n >= 20 and (top > 0.3 or len(index) < 0.05 * n)),
        _vote(not 2 <= chars / n <= 15),
        _vote(n >= 100 and per(".") == 0, n >= 50 and 0.01 <= per(".") <= 0.3 and symbols < 0.02 * n),
        _vote(n >= 50 and short < 0.02, 0.15 <= short <= 0.6 and repeats < 0.1 * n and symbols < 0.05 * n and upper < 0.2 * letters),
    )
    return n, chars, symbols, dup, repeats, "".join(votes)


@vectorized(METRICS)
def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split(":")[0] for x in METRICS[7:-1].split(",")]
    for part in texts:
        yield pd.DataFrame([measure(x) for x in part], columns=names)
        trim()


def with_metrics(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``into`` of the metrics and the votes of each row."""
    small_batches(docs.sparkSession)  # keep_good() measures before anything is stored
    return docs.withColumn(into, _measured(F.col(text).cast("binary")))


def posteriors(patterns: list[tuple[str, int]], rounds: int = 200) -> dict[str, float]:
    """The probability of good quality for each vote string, by EM on the counts of vote strings (Dawid and Skene).

    Each rule has, for each class, a probability of each vote, abstaining included: most rules only ever vote bad, so how often
    they speak is what tells. Pseudo-counts of prior beliefs (a rule votes bad on a good document once in a hundred, on a bad one
    three times in ten) keep the classes from trading places on small or one-sided corpora.
    """
    if not patterns:
        return {}
    votes = np.array([["BG-".index(c) for c in p] for p, _ in patterns])
    weight = np.array([k for _, k in patterns], float)
    belief = np.array([[0.01, 0.3, 0.69], [0.3, 0.05, 0.65]])  # class 0 good, 1 bad; votes B, G, -
    prior, p = 0.85, np.repeat(belief[:, None, :], votes.shape[1], axis=1)
    post, rule = np.zeros(len(weight)), np.arange(votes.shape[1])
    for _ in range(rounds):
        like = [np.log([prior, 1 - prior][c]) + np.log(p[c][rule, votes]).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        strength = 0.05 * weight.sum() + 10
        prior = ((weight * post).sum() + 0.85 * strength) / (weight.sum() + strength)
        for c, share in ((0, weight * post), (1, weight * (1 - post))):
            for v in range(3):
                p[c, :, v] = (share @ (votes == v) + strength * belief[c, v]) / (share.sum() + strength)
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def quality_verdicts(metrics: DataFrame, votes: str = "votes", into: str = "p_good") -> DataFrame:
    """``metrics`` and the posterior of each row. Only the counts of vote strings, at most 3**9, go to the driver."""
    counts = sorted((r[0], r[1]) for r in metrics.groupBy(F.col(votes).alias("v")).count().collect())
    model = posteriors(counts)
    table = metrics.sparkSession.createDataFrame(list(model.items()), f"`{votes}` string, `{into}` double")
    return metrics.join(F.broadcast(table), votes)


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def quality_report(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): the metrics, base_failed, p_good and kept.

    Null and empty texts have no words, fail the base and aren't kept. Repeated rows are each reported; a null doc_id
    stays null. An empty table gives an empty result.
    """
    flat = with_metrics(docs.select("doc_id", "text"), "m").select("doc_id", "m.*")
    scored = quality_verdicts(materialize(flat, "metrics"))
    return scored.withColumn("base_failed", F.expr(BASE_FAILED)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"), "p_good", "votes")


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names. The texts are read twice and never shuffled."""
    inner = with_metrics(docs.select("text"), "m").select("m.votes")
    model = posteriors(sorted((r[0], r[1]) for r in inner.groupBy("votes").count().collect()))
    good = sorted(v for v, p in model.items() if p >= least)
    failed = F.expr("m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return with_metrics(rows, "m").where(~failed & F.col("m.votes").isin(good)).select("row.*")
