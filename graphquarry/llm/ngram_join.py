"""N-gram Jaccard join by grouped prefixes: sets with one size and prefix form a group, only groups are joined on prefix shingles,
then group pairs are expanded to their members and verified on whole sets. Before a pair is made, marks of both (MARKS parities of
counts of shingles) must allow a link: sets that differ in d shingles differ in d marks at most, so that no link is lost.

Shingles are ordered by (code of document frequency, hash). Any one order makes prefix filtering exact; this one keeps
boilerplate out of the prefixes, so lists of documents that share a prefix shingle stay short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, gram_hashes, if_small, materialize, mix, trim, words_hashed

#: The table of frequencies has 2**16 to 2**25 slots of a byte, so its broadcast is 32 MB at most. Each Python worker holds a copy.
SLOTS = 16, 25
#: Frequencies are counted on so many leading bits of a hash.
_BITS = np.uint64(42)
#: A set's marks tell for each slot of a hash of so many whether an odd number of its shingles falls there, 64 to a long. In sets of
#: thousands of shingles most differences cancel out, so that they rule out less.
MARKS = 1024
_LONGS = range(MARKS // 64)
#: Hashes that a worker gathers before it counts them, which takes several arrays of their size.
HELD = 500_000


def shingles(raw: bytes | None, k: int = 5) -> np.ndarray:
    """The distinct hashes of k consecutive words, sorted; the whole sequence is one where there are fewer words."""
    words = words_hashed(raw or b"")
    grams = gram_hashes(words, min(k, len(words)) or k)
    if len(grams) < 2:
        return grams
    grams.sort()
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def _prefix_length(n: int, percent: int) -> int:
    """So many first shingles of a set of n share one with those of any set that is similar enough."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _short(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - int(_BITS))


def _counting(tokens_of, bits: int, width: int):
    """The two functions of frequency_table() that workers run; both give back the memory that they have used."""
    low = int(_BITS) - bits

    def packed(tokens: list[np.ndarray]) -> pd.DataFrame:
        token, n = np.unique(np.concatenate(tokens), return_counts=True)
        bucket = (token >> np.uint64(low)).astype(np.int64)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = token & np.uint64((1 << low) - 1)
        planes = [(rest >> np.uint64(8 * j)).astype(np.uint8) for j in range(-(-low // 8))]
        rows = []
        for a, b in zip(edge, [*edge[1:], len(token)], strict=True):
            rows.append((int(bucket[a]), int(b - a), b"".join(p[a:b].tobytes() for p in planes), n[a:b].astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "n", "tokens", "counts"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for part in batches:
            for raw in part["text"]:
                held.append(_short(tokens_of(raw)))
                total += len(held[-1])
                if total > HELD:
                    yield packed(held)
                    held, total = [], 0
            trim()
        if total:
            yield packed(held)
        held.clear()
        trim()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts, counts = [], []
        for n, raw, c in zip(group["n"], group["tokens"], group["counts"], strict=True):
            planes = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.uint64)
            parts.append(sum((p << np.uint64(8 * j) for j, p in enumerate(planes)), np.zeros(n, np.uint64)))
            counts.append(np.frombuffer(c, np.uint32))
        token, at = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts))
        often = n >= 2
        slots = np.zeros(1 << (width - bits), np.uint8)
        np.maximum.at(slots, (token[often] >> np.uint64(low - (width - bits))).astype(np.int64), code_of(n[often]))
        del parts, counts, token, at, n, often
        trim()
        return pd.DataFrame({"bucket": [int(key[0])], "slots": [zlib.compress(slots.tobytes(), 1)]})

    return count, merge


def frequency_table(docs: DataFrame, tokens_of) -> bytes:
    """A byte for each leading-bits slot of the hash space: 0 where no hash of ``tokens_of`` comes twice or more over the texts of
    ``docs``, else the code of the highest count there (8 a doubling).

    Counting is exact and covers every hash: each task counts its own and emits, for each bucket of the hash space, one row of packed
    arrays, so a frequent hash makes no bucket larger, and there are as many buckets as keep each small. What is rounded is the table:
    a slot that several hashes share tells of a hash more than its own count. Who uses it must be right with any table; a
    corpus beyond its size only gets more work, not other results. The driver reads it a partition at a time.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(16, max(7, np.ceil(np.log2(size / 6 / 500_000 + 1)))))
    width = int(min(SLOTS[1], max(SLOTS[0], np.ceil(np.log2(size / 12 + 1)))))
    count, merge = _counting(tokens_of, bits, width)
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "bucket int, n int, tokens binary, counts binary")
    table = np.zeros(1 << width, np.uint8)
    for r in materialize(rows.groupBy("bucket").applyInPandas(merge, "bucket int, slots binary"), "frequencies").toLocalIterator():
        at = r["bucket"] << (width - bits)
        table[at : at + (1 << (width - bits))] = np.frombuffer(zlib.decompress(r["slots"]), np.uint8)
    return table.tobytes()  # an array would be copied once more when a worker reads it


def code_of(n) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(n)).astype(np.uint8)


def looked_up(raw: bytes, tokens: np.ndarray) -> np.ndarray:
    table = np.frombuffer(raw, np.uint8)
    return table[(tokens >> np.uint64(64 - int(len(table)).bit_length() + 1)).astype(np.int64)]


def _marks(own: np.ndarray) -> np.ndarray:
    """The marks of a set of hashes; none of an empty one."""
    if not len(own):
        return np.empty(0, np.int64)
    odd = np.bincount((own & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _may_link(percent: int, sizes: str, a: str, b: str, blurs: tuple[str, ...] = ()) -> str:
    """Whether marks (columns a0, a1 .. and b0, b1 ..) allow a link of sets of ``sizes`` shingles together: those that only one of two
    linked sets has are (100 - percent) / (100 + percent) of that at most. Marks that are set in columns of ``blurs`` don't tell."""
    but = lambda i: f" & ~({' | '.join(f'{x}{i}' for x in blurs)})" if blurs else ""
    return f"{100 + percent} * ({' + '.join(f'bit_count(({a}{i} ^ {b}{i}){but(i)})' for i in _LONGS)}) <= {100 - percent} * ({sizes})"


def _described(shared, percent: int, k: int):
    def describe(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for part in texts:
            out = []
            for raw in part:
                own = shingles(raw, k)
                n, order = len(own), looked_up(table, own)
                # A shingle of no other document is in no intersection: a set with too many of them links with nothing.
                alone = int((order == 0).sum())
                linkable = 100 * (n - alone) >= percent * n
                first = own[np.lexsort((own, order))[: _prefix_length(n, percent) if linkable else 0]].view(np.int64)
                whole = mix(own + np.uint64(1))
                cls = int(mix(np.array([whole.sum() ^ np.uint64(n)], np.uint64)).view(np.int64)[0]) if n else 0
                out.append((n, alone, cls, first, _marks(own if len(first) else own[:0])))
            yield pd.DataFrame(out, columns=["n", "alone", "cls", "prefix", "marks"])
            del out
            trim()

    return F.pandas_udf(describe, "struct<n:bigint,alone:bigint,cls:bigint,prefix:array<bigint>,marks:array<bigint>>")


def _setter(k: int):
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            out = []
            for raw in part:
                own = shingles(raw, k)
                whole = mix(own + np.uint64(1))
                out.append((int(mix(np.array([whole.sum() ^ np.uint64(len(own))], np.uint64)).view(np.int64)[0]) if len(own) else 0, own.tobytes()))
            yield pd.DataFrame(out, columns=["cls", "own"])
            del out
            trim()

    return F.pandas_udf(sets, "struct<cls:bigint,own:binary>")


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        def check(x, y):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            return 100 * both >= percent * (len(x) + len(y) - both)

        found = pd.Series([check(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)
        trim()
        return found

    return linked


class Join:
    """The join of a table (doc_id, text) with itself at ``percent`` Jaccard similarity of word ``k``-shingles.

    rows     doc_id, sig (a hash of the text), n, alone, cls: one row per row of the table; cls is a 64-bit hash of the whole set, so equal sets are one class
    classes  cls, n, alone, doc (smallest doc_id), gid (the group of its size and prefix: the smallest class in it)
    links()  verified pairs (a, b) of classes that connect all that any linked pairs connect
    """

    def __init__(self, docs: DataFrame, percent: int = 75, k: int = 5):
        self.docs, self.percent, self.k = docs.select("doc_id", "text"), percent, k
        shared = docs.sparkSession.sparkContext.broadcast(frequency_table(self.docs, lambda raw: shingles(raw, k)))
        described = self.docs.select("doc_id", F.xxhash64("text").alias("sig"), _described(shared, percent, k)(F.col("text").cast("binary")).alias("d")).select("doc_id", "sig", "d.*")
        self.rows = materialize(described.withColumn("pkey", F.xxhash64("n", "prefix")), "sets")
        shared.destroy()  # the sets are stored; workers and executors would hold the table until the driver collects its garbage
        classes = self.rows.where("n > 0").groupBy("cls", "n", "alone", "pkey").agg(F.min("doc_id").alias("doc"))
        groups = classes.where(f"100 * (n - alone) >= {percent} * n").groupBy("n", "pkey").agg(F.min("cls").alias("gid"))
        self.classes = materialize(classes.join(groups, ["n", "pkey"], "left").select("cls", "n", "alone", "doc", "gid"), "classes")

    def _postings(self) -> DataFrame:
        """(token, gid, n) of each group's prefix."""
        heads = self.classes.where("cls = gid").select("cls", F.col("doc").alias("doc_id"))
        few = if_small(materialize(heads, "heads"), 1_000_000).withColumnsRenamed({"cls": "c", "doc_id": "d"})
        prefix = self.rows.join(few, (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        return prefix.select(F.col("cls").alias("gid"), "n", (F.col("n") - F.col("alone")).alias("u"), F.explode("prefix").alias("token"))

    def _marked(self, classes: DataFrame) -> DataFrame:
        """``classes`` (cls, doc, ..) with the marks m0, m1 .. of their sets."""
        classes = materialize(classes, "unmarked")
        few = if_small(classes, 1_000_000).select(F.col("cls").alias("c"), F.col("doc").alias("d"))
        rows = self.rows.join(few, (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        marks = rows.select("cls", *[F.get("marks", F.lit(i)).alias(f"m{i}") for i in _LONGS]).dropDuplicates(["cls"])
        return materialize(classes.join(marks, "cls"), "marked")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes that are linked. The documents are read again for the sets of the classes met."""
        pairs = materialize(pairs, "pairs")
        met = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        wanted = materialize(self.classes.join(met, "cls", "left_semi").select("cls", "doc"), "met")
        few = if_small(wanted, 1_000_000)
        held = self.docs.join(few.select(F.col("doc")), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
        sets = held.select(_setter(self.k)(F.col("text").cast("binary")).alias("s")).select("s.*").join(few.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        sets = materialize(sets, "own")
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("own").alias("y")), "b")
        return materialize(both.where(_linked(self.percent)("x", "y")).select("a", "b"), "verified")

    def links(self) -> DataFrame:
        # u and v are the shingles that are shared at all: no intersection is larger.
        close = f"{100 + self.percent} * least(u, v) >= {self.percent} * (n + m)"
        lists = self._postings()
        size = lists.groupBy("token").agg(F.count(F.lit(1)).alias("len"), F.min(F.struct((F.col("n") - F.col("u")).alias("alone"), "gid", "n", "u")).alias("low"), F.min(F.struct(F.xxhash64("gid").alias("h"), "gid", "n", "u")).alias("any")).where("len > 1")
        shared = materialize(lists.join(size, "token"), "postings")
        # Round one: each group against two hubs of each of its lists (the one with the fewest shingles of its own, which is nearest
        # to what a family of copies has in common, and any one), each class against its group's first.
        to = lambda hub: shared.select(F.col(f"{hub}.gid").alias("a"), F.col("gid").alias("b"), "n", "u", F.col(f"{hub}.n").alias("m"), F.col(f"{hub}.u").alias("v")).where(f"a <> b and {close}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        inside = self.classes.where("cls <> gid").select(F.least("cls", "gid").alias("a"), F.greatest("cls", "gid").alias("b"))
        first = to("low").unionByName(to("any")).unionByName(inside).distinct()
        done = self._verified(first)
        # Then every pair of a list or a group whose ends no link connects yet and whose marks allow one.
        label = components(done, "a", "b").withColumnsRenamed({"node": "cls"})
        known = materialize(self.classes.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "known")
        grouped = known.where("gid is not null")
        many = grouped.groupBy("gid").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
        spread = shared.select("token", "gid", "n", "u").join(many, "gid")
        mixed = spread.groupBy("token").agg(F.min("c1").alias("lo"), F.max("c2").alias("hi")).where("lo <> hi").select("token")
        rest = materialize(spread.join(mixed, "token").select("token", "gid", "n", "u", "c1", "c2"), "mixed")
        met = rest.select("gid").unionByName(many.where("c1 <> c2").select("gid")).distinct()
        members = self._marked(grouped.join(met, "gid", "left_semi").select("cls", "doc", "gid", "n", "component"))
        # A group's marks (s) are those of its members where they agree; its blurs (x) are where they don't.
        each = [*[F.bit_and(f"m{i}").alias(f"s{i}") for i in _LONGS], *[F.expr(f"bit_and(m{i}) ^ bit_or(m{i})").alias(f"x{i}") for i in _LONGS]]
        rest = rest.join(materialize(members.groupBy("gid").agg(*each), "marks"), "gid")
        named = {"gid": "g2", "n": "m", "u": "v", "c1": "d1", "c2": "d2", **{f"s{i}": f"t{i}" for i in _LONGS}, **{f"x{i}": f"y{i}" for i in _LONGS}}
        near = _may_link(self.percent, "n + m", "s", "t", ("x", "y"))
        pairs = rest.join(rest.withColumnsRenamed(named), "token").where(f"gid < g2 and not (c1 = d1 and c2 = d2 and c1 = c2) and {close} and {near}").select("gid", "g2").distinct()
        own = many.where("c1 <> c2").select("gid", F.col("gid").alias("g2"))
        left = members.withColumnsRenamed({"cls": "a", "component": "ca"}).drop("doc")
        right = members.withColumnsRenamed({"cls": "b", "gid": "g2", "n": "m", "component": "cb", **{f"m{i}": f"w{i}" for i in _LONGS}}).drop("doc")
        expanded = pairs.unionByName(own).join(left, "gid").join(right, "g2").where(f"ca <> cb and a <> b and {_may_link(self.percent, 'n + m', 'm', 'w')}")
        more = self._verified(expanded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return done.unionByName(more)


def class_components(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, and cls, the class of equal sets, per row of ``docs``."""
    join = Join(docs, percent, k)
    label = components(join.links(), "a", "b").withColumnsRenamed({"node": "cls"})
    named = join.classes.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("doc").alias("low"))
    found = named.join(lowest, "component").select("cls", "low")
    full = join.rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "cls").join(materialize(found, "found"), "cls").select("doc_id", "n_shingles", F.col("low").alias("component_id"), "cls")
    empty = join.rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cls")
    return full.unionByName(empty)


def linked_components(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Null, empty and wordless texts have no shingles and link with nothing: their component is themselves. Rows with a null
    doc_id link as others; a component of such rows alone is null. Repeated rows are of one class and each reported. Other
    columns are ignored.
    """
    return class_components(docs, percent, k).drop("cls")


def one_of_each(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept; rows without words all stay.

    It is the row of the smallest doc_id, null last; of rows with that doc_id the one whose text has the smallest hash, and of rows
    that repeat both the one whose other columns have.
    """
    join = Join(docs, percent, k)
    label = components(join.links(), "a", "b").withColumnsRenamed({"node": "cls"})
    own = join.rows.where("n > 0").groupBy("cls", "doc_id", "sig").agg(F.count(F.lit(1)).alias("times"))
    named = materialize(own.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "named")
    low = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig")).alias("low"))
    first = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("sig") == F.col("low.sig"))
    marked = named.join(low, "component").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), first.alias("__first"), "times").where("not __first or times > 1")
    marked = materialize(marked, "marked")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__sig"))
    kept = docs.join(if_small(marked, 1_000_000), same, "left_anti")
    twice = marked.where("__first")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    again = docs.join(if_small(twice, 1_000_000), same, "left_semi").withColumn("__at", F.row_number().over(order)).where("__at = 1")
    return kept.unionByName(again.select(*docs.columns))
