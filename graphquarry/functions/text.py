"""Text functions on columns: complexity, type references, naming, secrets, snippets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and operators that text complexity counts.
KEYWORDS = ("if ", "for ", "while ", "catch ", "case ", "elif ", "else if ")
OPERATORS = ("&&", "||", "and", "or", "??")

# Secret patterns by name.
SECRETS = (
    ("aws_access_key_id", r"AKIA[0-9A-Z]{16}"),
    ("aws_secret_access_key", r"""(?i)(aws_secret_access_key|aws_secret_key)\s*[=:]\s*['"]?([A-Za-z0-9/+=]{40})['"]?"""),
    ("gcp_api_key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("openai_api_key", r"sk-[A-Za-z0-9]{20,}"),
    ("openai_project_key", r"sk-proj-[A-Za-z0-9]{20,}"),
    ("stripe_api_key", r"sk_live_[A-Za-z0-9]{24,}"),
    ("stripe_test_key", r"sk_test_[A-Za-z0-9]{24,}"),
    ("rsa_private_key", r"-----BEGIN RSA PRIVATE KEY-----"),
    ("private_key", r"-----BEGIN PRIVATE KEY-----"),
    ("openssh_private_key", r"-----BEGIN OPENSSH PRIVATE KEY-----"),
    ("postgres_uri", r"postgres(?:ql)?://[^:]+:[^@]+@[^\s]+"),
    ("mongodb_uri", r"mongodb(?:\+srv)?://[^:]+:[^@]+@[^\s]+"),
    ("redis_uri", r"redis://[^:]+:[^@]+@[^\s]+"),
    ("generic_api_key", r"""(?i)(api_key|apikey|api-key)\s*[=:]\s*['"]?([A-Za-z0-9_\-]{20,})['"]?"""),
    ("generic_secret", r"""(?i)(secret|password|passwd|pwd)\s*[=:]\s*['"]?([^\s'"]{8,})['"]?"""),
    ("bearer_token", r"(?i)bearer\s+[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+"),
)


def vectorized(returns: str):
    """A pandas UDF that is made when it is first used: parsing its type needs a session, importing this module doesn't."""
    return lambda f: lambda *columns: F.pandas_udf(f, returns)(*columns)


def occurrences(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def complexity(text: Column) -> Column:
    """1 and a point for each keyword and operator found as a substring."""
    total = F.lit(1)
    for part in KEYWORDS + OPERATORS:
        total = total + occurrences(text, part)
    return total


def type_references(text: Column, builtins: tuple[str, ...] = ()) -> Column:
    # A word's ends are those of ASCII words: a letter beyond ASCII before or behind a name ends it.
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9_]*)"), F.lit(1)))
    return F.array_sort(F.array_except(found, F.array(*[F.lit(b) for b in builtins]).cast("array<string>")))


def naming(name: Column) -> Column:
    """The first convention that a name meets: dunder, screaming, snake, camel, pascal, kebab, other."""
    rules = (("dunder", r"^__[a-z0-9_]+__$"), ("screaming", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), ("snake", r"^_*[a-z0-9]+(_[a-z0-9]+)*_?$"), ("camel", r"^[a-z]+[a-zA-Z0-9]*$"), ("pascal", r"^[A-Z][a-zA-Z0-9]*$"), ("kebab", r"^[a-z0-9]+(-[a-z0-9]+)+$"))
    out = F.lit("other")
    for kind, pattern in reversed(rules):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"), r"[-\s]+", "_"))


@vectorized("array<struct<name:string,start:int,end:int>>")
def find_secrets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re

    compiled = [(n, re.compile(p)) for n, p in SECRETS]
    for part in texts:
        yield pd.Series([[(n, *m.span()) for n, p in compiled for m in p.finditer(x or "")] for x in part])


@vectorized("string")
def redact(texts: pd.Series) -> pd.Series:
    """Secrets replaced by their kind; overlapping ones are merged under the first one's."""
    import re

    compiled = [(n, re.compile(p)) for n, p in SECRETS]

    def one(x):
        if x is None:
            return None
        out, last = [], 0
        for a, b, n in sorted((*m.span(), n) for n, p in compiled for m in p.finditer(x)):
            if a >= last:
                out += [x[last:a], f":: REDACTED:{n}"]
            last = max(last, b)
        return "".join(out) + x[last:]

    return texts.map(one, na_action=None)
