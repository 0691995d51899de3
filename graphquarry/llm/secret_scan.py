"""Secret scans with corpus-wide ownership: a candidate that many owners or repositories share is an example, one owner's own, in few
repositories, looks live. What isn't certain by its form becomes a span only where its ownership says that it is live."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, vectorized
from .spans import joined, sha256

KINDS = ("assign", "access", "hex", "opaque", "upper", "vendor", "bearer", "url", "pem", "short")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates beyond the base kinds: what a text that has one holds, and the pattern, whose second group is the secret. Only their
#: ownership makes them spans. Values of six to eleven characters where base has twelve or more are of the kind short.
_MORE = (
    ("opaque", ("",), re.compile(r"(?<![A-Za-z0-9_-])()([A-Za-z0-9_-]{24,})")),
    ("upper", ("",), re.compile(r"(?<![0-9A-Za-z])()([0-9A-F]{16,})(?![0-9A-Za-z])")),
    ("vendor", ("gh", "sk-", "sk_", "xox", "AIza", "glpat-"), re.compile(r"(?<![A-Za-z0-9])()((?:gh[pousr]_|sk-|sk_live_|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_-]{16,})")),
    ("bearer", ("earer ", "EARER "), re.compile(r"(bearer)\x20+([A-Za-z0-9._~+/=-]{16,})", re.A | re.I)),
    ("url", ("://",), re.compile(r"([a-z][a-z0-9+]{1,15}://[^\s:/@]{1,64}):([^\s:/@]{4,64})(?=@)", re.A)),
    ("pem", ("-----BEGIN ",), re.compile(r"-----BEGIN ([A-Z ]{0,20})PRIVATE KEY-----([^-]{0,10000})", re.A)),
)
_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("hash", T.StringType())]))


def entropy(text: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def find_secrets(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, hash of the secret) of every candidate; positions are code points, the end is exclusive.

    The base kinds are found leftmost without overlap, each for itself, and dropped where too short. A run of 16 or more of
    a class is the same as the maximal run with its length checked.
    """
    text = text or ""
    found = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            found.append(("assign", *m.span(), True, m[2]))
        elif len(m[2]) >= 6 and any(c.isdigit() for c in m[2]):
            found.append(("short", *m.span(), False, m[2]))
    found += [("access", *m.span(), True, m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), True, m[0]) for m in _HEX.finditer(text)]
    for kind, marks, pattern in _MORE:
        if any(mark in text for mark in marks):
            found += [(kind, *m.span(), False, m[2]) for m in pattern.finditer(text) if _looks_random(kind, m[2])]
    return [(k, a, b, base, sha256(v)) for k, a, b, base, v in found]


def _looks_random(kind: str, secret: str) -> bool:
    """Whether a candidate's characters could be a secret's: words and plain numbers aren't."""
    digits = any(c.isdigit() for c in secret)
    if kind == "opaque":
        return digits and secret.lower() != secret != secret.upper() and entropy(secret) >= 3.5
    if kind == "upper":
        return digits and any("A" <= c <= "F" for c in secret)
    return digits if kind in ("vendor", "bearer") else True


@vectorized(_FOUND)
def _found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([find_secrets(x) for x in part])


@vectorized("struct<spans:string,base_sha256:string>")
def _digest(lists: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in lists:
        rows = []
        for found in part:
            every = [(x["kind"], x["start"], x["end"], x["base"]) for x in found]
            base = joined([x[:3] for x in every if x[3]], KINDS)
            rows.append((joined([x[:3] for x in every], KINDS), sha256(base)))
        yield pd.DataFrame(rows, columns=["spans", "base_sha256"])


#: (owners, repositories) up to which a secret looks live, and from which on either makes it an example.
LIVE, SHARED = (1, 3), (3, 12)


def verdict(owners: Column, repositories: Column, live: tuple[int, int] = LIVE, shared: tuple[int, int] = SHARED) -> Column:
    """'example' where many owners or many repositories have a secret, 'live' where few owners have it in few, else 'unclear'."""
    return F.when((owners >= shared[0]) | (repositories >= shared[1]), "example").when((owners <= live[0]) & (repositories <= live[1]), "live").otherwise("unclear")


def secret_spans(docs: DataFrame, repository: str = "doc_id", owner: str = "source", live: tuple[int, int] = LIVE, shared: tuple[int, int] = SHARED) -> DataFrame:
    """One row per candidate: row (an id of the row of ``docs``), doc_id, kind, start, end, base, hash, n_owners, n_repositories, verdict.

    A null owner or repository counts as one of its own. See verdict(), and _scan() for the counting.
    """
    return _scan(docs, repository, owner, live, shared)[1]


def _scan(docs: DataFrame, repository: str, owner: str, live: tuple[int, int], shared: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their candidates (stored, read once), and the judged candidates.

    Distinct owners and repositories are counted by two aggregations, each combined before its shuffle, so a secret that a
    third of all documents has costs a row for each owner and task. Null texts are empty; repeated rows count once for
    their owner; other columns of ``docs`` aren't read.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), _found("text").alias("found"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.where("size(found) > 0").select("row", "doc_id", "repository", "owner", F.explode("found").alias("f")).select("row", "doc_id", "repository", "owner", "f.*")
    count = lambda c: each.select("hash", c).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    stats = count("owner").join(count("repository"), "hash").withColumnsRenamed({"n_owner": "n_owners", "n_repository": "n_repositories"})
    judged = verdict(F.col("n_owners"), F.col("n_repositories"), live, shared)
    return rows, each.join(stats, "hash").withColumn("verdict", judged).drop("repository", "owner")


def secret_report(docs: DataFrame, repository: str = "doc_id", owner: str = "source", live: tuple[int, int] = LIVE, shared: tuple[int, int] = SHARED) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of the base spans, all spans, n_live, n_example.

    Spans that ownership adds are candidates of the other kinds with the verdict 'live'; base spans stay whatever their verdict. Null and empty
    texts have none. Repeated rows are each reported.
    """
    rows, judged = _scan(docs, repository, owner, live, shared)
    kept = judged.where("base or verdict = 'live'").groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end", "base")).alias("spans"),
        *[F.count_if(F.expr(f"base and kind = '{k}'")).alias(f"n_{k}") for k in KINDS[:3]],
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example")],
    )
    wide = rows.where("size(found) > 0").select("row", "doc_id").join(kept, "row", "left")
    none = rows.where("size(found) = 0").select("doc_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = ["n_assign", "n_access", "n_hex", "n_live", "n_example"]
    some = wide.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,base:boolean>>)"))).withColumn("d", _digest("spans"))
    some = some.select("doc_id", *map(zero, counts), "d.base_sha256", "d.spans")
    empty = none.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return some.unionByName(empty)
