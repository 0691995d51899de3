"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, EM weighs them, and a
span classifier trained on the posteriors decides which spans are added to the certain ones."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, vectorized
from .spans import joined, sha256

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "handle", "number", "account", "name", "street", "birth")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EXTRA = (
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
    ("handle", re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@.])")),
    ("number", re.compile(r"(?<![0-9.,+-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9])")),
)
#: What the gazetteer and the context propose by themselves: a text must hold one of the marks, the group is the span.
_PROPOSED = (
    ("name", ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Sr", "Mme", "Miss"), re.compile(r"\b(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Sra?|Mme)\.?\x20+((?:[A-Z][a-zà-ÿ'-]+)(?:\x20+[A-Z][a-zà-ÿ'-]+){0,2})")),
    ("street", ("treet", "venue", "Road", "Lane", "oulevard", "traße", "rue ", "Rue ", "alle ", "Calle "), re.compile(r"\b([0-9]{1,5}[A-Za-z]?,?\x20(?:[Rr]ue\x20[A-Z]\w+|(?:[A-Z]\w+\x20){1,3}(?:Street|Avenue|Road|Lane|Boulevard))|(?:[A-Z]\w*straße|[A-Z]\w+\x20Straße|Calle\x20[A-Z]\w+)\x20[0-9]{1,5}[a-z]?)\b")),
    ("birth", ("born", "birth", "dob", "DOB", "geboren", "nacid", "née", "né "), re.compile(r"(?:born(?:\x20on)?|birth(?:day|\x20date)?|dob|DOB|geboren(?:\x20am)?|nacid[oa](?:\x20el)?|née?(?:\x20le)?)[:\x20]{1,3}([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4})")),
)
#: Personal data within so many characters of a candidate speaks for it.
COMPANY = 200
#: Words of the gazetteer labeler, each near the kinds that it speaks for.
GAZETTEER = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone"), "email": ("mail", "contact", "correo", "courriel"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"), "ip": ("ip", "host", "server", "address", "login"), "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"), "handle": ("follow", "twitter", "instagram", "user"), "number": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "account": ("account", "bank", "konto", "cuenta", "compte", "card", "karte", "tarjeta", "carte", "passport", "customer"), "name": ("name", "dear", "signed"), "street": ("address", "live", "lives", "adresse"), "birth": ("born", "birth", "dob", "geboren"),
}
GAZETTEER = {kind: frozenset(words) for kind, words in GAZETTEER.items()}
#: What tells against each kind when it stands near.
_AGAINST = frozenset(("version", "isbn", "page", "order", "chapter", "invoice", "serial"))
_WORDS = re.compile(r"[^\W\d_]+")
_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("cell", T.StringType())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of the e-mail pattern, found from each @ so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four certain kinds: leftmost without overlap, each for itself; failing matches are dropped."""
    text = text or ""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _near(text: str, start: int, end: int) -> set[str]:
    return {w.lower() for w in _WORDS.findall(text[max(0, start - 40) : start] + " " + text[end : end + 20])}


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str, str]]:
    """Base spans and possible further ones, each with the votes of the three labelers and a cell of discrete features.

    Votes (P personal, N not, - abstains; ! before those of certain spans): regex by the form of the span, gazetteer by the words near it, context by the
    characters next to it and by certain personal data nearby. The latter two also propose spans (_PROPOSED).
    """
    text = text or ""
    base = base_spans(text)
    every = [(*s, True) for s in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        """Whether no certain span overlaps; those of one kind don't overlap each other, and there are four kinds."""
        i = bisect.bisect_left(starts, b)
        return all(y <= a for _, y in taken[max(0, i - 8) : i])

    more = [(kind, *m.span()) for kind, pattern in _EXTRA for m in pattern.finditer(text)]
    # A long number that isn't a card by its check digit may be another account's.
    more += [("account", *m.span()) for m in _CARD.finditer(text) if 12 <= m.end() - m.start() <= 40 and 12 <= len(_digits(m[0])) <= 19]
    more += [(kind, *m.span(1)) for kind, marks, pattern in _PROPOSED if any(x in text for x in marks) for m in pattern.finditer(text)]
    # A group of digits is a date's or a number's of its own kind first.
    own = {(a, b) for kind, a, b in more if kind in ("birth", "ssn", "iban", "account")}
    every += [(kind, a, b, False) for kind, a, b in more if free(a, b) and (kind != "number" or (a, b) not in own)]
    out = []
    for kind, a, b, is_base in every:
        s, words = text[a:b], _near(text, a, b)
        digits, before, after = _digits(s), text[a - 1 : a], text[b : b + 1]
        form = "P" if is_base or (kind == "ssn" and not digits.startswith(("000", "666", "9"))) or (kind == "iban" and sum(c.isdigit() for c in s) >= 10) or kind == "birth" else "N" if kind == "number" and not 7 <= len(digits) <= 13 else "-"
        listed = "N" if words & _AGAINST else "P" if words & GAZETTEER[kind] or kind in ("name", "street") else "-"
        clean = (not before or before in " \n\t(:<'\"") and (not after or after in " \n\t).,;:>'\"")
        i = bisect.bisect_left(starts, a - COMPANY)
        company = any(x != a or y != b for x, y in taken[i : i + 4] if x <= b + COMPANY)
        context = "N" if not clean else "P" if company or text[max(0, a - 2) : a].endswith((": ", "= ")) else "-"
        cell = f"{kind}|{min(len(digits), 20) // 3}|{'a' if before.isalnum() else 's' if before.isspace() else 'p'}|{'a' if after.isalnum() else 's' if after.isspace() else 'p'}|{min(len(words & GAZETTEER[kind]), 1)}|{int(company)}"
        out.append((kind, a, b, is_base, f"{'!' * is_base}{form}{listed}{context}", cell))
    return out


@vectorized(_FOUND)
def _found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([candidates(x) for x in part])


def reliabilities(patterns: list[tuple[str, int]], balance: float = 0.5, rounds: int = 200) -> dict[str, float]:
    """The probability of personal data for each vote string, by EM over the counts; each labeler has one accuracy.

    A string that begins with ! is of certain spans: they are personal data, and tell how right the labelers are. ``balance`` is the
    share of the others that are: votes of few labelers that mostly abstain can't tell it beside their accuracies.
    """
    if not patterns:
        return {}
    votes = np.array([[{"P": 1, "N": -1, "-": 0}[c] for c in p.removeprefix("!")] for p, _ in patterns])
    sure = np.array([p.startswith("!") for p, _ in patterns])
    weight = np.array([k for _, k in patterns], float)
    first = np.array([0.9, 0.75, 0.7])
    right, post = first, np.zeros(len(weight))
    for _ in range(rounds):
        odds = np.log(balance / (1 - balance)) + (votes * np.log(right / (1 - right))).sum(1)
        new = np.where(sure, 1.0, 1 / (1 + np.exp(-odds)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        agree = weight @ ((votes == 1) * post[:, None] + (votes == -1) * (1 - post)[:, None])
        right = np.clip((agree + first * 20) / (weight @ (votes != 0) + 20), 0.55, 0.99)
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def _features(cells: list[str]) -> tuple[np.ndarray, list[str]]:
    names = sorted({f"{i}={x}" for c in cells for i, x in enumerate(c.split("|"))} | {"bias"})
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(cells), len(names)))
    x[:, at["bias"]] = 1
    for r, c in enumerate(cells):
        for i, v in enumerate(c.split("|")):
            x[r, at[f"{i}={v}"]] = 1
    return x, names


def span_classifier(cells: list[tuple[str, float, float]], steps: int = 300) -> dict[str, float]:
    """P(personal) for each feature cell by logistic regression on (cell, weight, mean posterior)."""
    if not cells:
        return {}
    x, _ = _features([c for c, _, _ in cells])
    weight, y = np.array([w for _, w, _ in cells]), np.array([p for _, _, p in cells])
    weight = weight / weight.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= 2.0 * (x.T @ (weight * (p - y)) + 1e-4 * theta)
    return {c: float(v) for (c, _, _), v in zip(cells, 1 / (1 + np.exp(-x @ theta)), strict=True)}


@vectorized("struct<spans:string,base_sha256:string>")
def _digest(lists: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in lists:
        rows = []
        for found in part:
            every = [(x["kind"], x["start"], x["end"], x["base"]) for x in found]
            rows.append((joined([x[:3] for x in every], KINDS), sha256(joined([x[:3] for x in every if x[3]], KINDS))))
        yield pd.DataFrame(rows, columns=["spans", "base_sha256"])


def pii_report(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns aren't read): counts of the base kinds, digest, spans, n_added.

    A span beside the base ones stays where the classifier gives it ``least`` or more. To the driver go only the counts of vote
    strings (54 at most) and of feature cells (kind, digits by threes, three kinds of neighbours on each side, gazetteer or
    not, personal data nearby or not: 3,024 at most), whatever the size of the corpus. Null and empty texts have no spans.
    """
    rows = materialize(docs.select("doc_id", _found("text").alias("found")), "pii")
    each = rows.where("size(found) > 0").select(F.explode("found").alias("f")).select("f.*")
    cells = each.groupBy("cell", "votes").count().collect()
    by_vote: dict[str, int] = {}
    for r in cells:
        by_vote[r["votes"]] = by_vote.get(r["votes"], 0) + r["count"]
    post = reliabilities(sorted(by_vote.items()))
    grouped: dict[str, list[float]] = {}
    for r in sorted(cells, key=lambda r: (r["cell"], r["votes"])):
        w = grouped.setdefault(r["cell"], [0.0, 0.0])
        w[0] += r["count"]
        w[1] += r["count"] * post[r["votes"]]
    model = span_classifier([(c, w, s / w) for c, (w, s) in grouped.items()])
    good = sorted(c for c, p in model.items() if p >= least)
    kept = rows.withColumn("kept", F.filter("found", lambda f: f["base"] | f["cell"].isin(good)))
    n = lambda k: F.size(F.filter("kept", lambda f: f["base"] & (f["kind"] == k))).cast("long").alias(f"n_{k}")
    added = F.size(F.filter("kept", lambda f: ~f["base"])).cast("long").alias("n_added")
    return kept.withColumn("d", _digest("kept")).select("doc_id", *map(n, KINDS[:4]), "d.base_sha256", "d.spans", added, F.size("kept").cast("long").alias("n_spans"))
