"""Mixing sources to target weights: texts are packed into fixed-length blocks, each output shard draws multinomial counts of
its sources, and each draw goes through a pseudorandom permutation of its source's block indexes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Rounds of the swap-or-not permutation.
ROUNDS = 8
#: A word with the white space behind it, and at the start of a text before it.
CHUNK = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(sidx, source, source_size, target) from (source, source_size): one row per source, so few rows.

    Sources by code point, null last, weigh ``weights`` in turn and share the total size; a target stops at ``cap`` times its
    source's size and the excess is shared again by weight. That has one level at its end: with sources by cap / weight, those
    before the first that the level of the rest leaves below its cap get their cap, the others weight times that level.
    """
    by_name, by_room = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("room", "sidx")
    ranked = sizes.withColumn("sidx", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sidx") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("room", F.col("top") / F.col("w"))
    before = F.coalesce(F.sum("top").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (total - before) / rest).withColumn("at", F.row_number().over(by_room))
    first = F.min(F.when(F.col("room") > F.col("level"), F.struct("at", "level"))).over(Window.partitionBy())
    done = level.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("top")).otherwise(F.col("w") * F.col("first.level"))
    return done.select("sidx", "source", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each ``key``: swap-or-not, a bijection whatever n is."""
    other = lambda x, r: F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
    step = lambda x, r: F.when(F.pmod(F.xxhash64(*key, F.lit(7), r, F.greatest(x, other(x, r))), F.lit(2)) == 1, other(x, r)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


class Mix:
    """A mix of ``docs``. Its parts are DataFrames:

    sizes   one row per row of docs: row, doc_id, sidx, size (words; null text: 0)
    sources sidx, source, source_size, target, n_blocks, quota (blocks that the mix takes), last (words that its last block gives)
    pieces  the packing: sidx, block, row, doc_id, first (word), n (words), at (its first word's place in the block); blocks of
            ``length`` words, a source's last is shorter
    draws   shard, sidx, draw, block, words (that are taken of the block): the output's slots

    A source's blocks come in turns of all of them, the shorter one last in each; of the last block drawn only so many words are taken
    that the source gives its target, rounded down.

    Docs with no words lie in no block. Null sources are a source. Repeated rows count each. Only the table of sources goes
    to the driver. A hot source is one of many (source, bucket) pairs wherever rows are dealt out, never one task's.
    """

    def __init__(self, docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, length: int = 128, shard: int = 1024, seed: int = 17, texts: bool = False):
        self.spark, self.seed, self.cap = docs.sparkSession, seed, cap
        size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0))
        rows = docs.select("doc_id", "source", F.greatest(size, F.lit(0)).cast("long").alias("size"), *([F.col("text")] if texts else []))
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
        totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        self.n_docs = 0
        table = []
        kept = totals.persist()
        for r in kept.select("n").collect():
            self.n_docs += r["n"]
        table = [r.asDict() for r in targets(kept.select("source", "source_size"), weights, cap).collect()]
        kept.unpersist()
        self.length = length
        for r in table:
            size, want = r["source_size"], r["target"]
            r["n_blocks"] = -(-size // length)
            turns, rest = divmod(min(int(want + 1e-6), int(cap * size)), size) if size else (0, 0)
            r["quota"] = turns * r["n_blocks"] + -(-rest // length)
            r["last"] = rest - (-(-rest // length) - 1) * length if rest else length
        self.table = sorted(table, key=lambda r: r["sidx"])
        self.total = sum(r["quota"] for r in table)
        self.shard = max(shard, self.total // 1_000_000)
        schema = "sidx int, source string, source_size long, target double, n_blocks long, quota long, last long"
        self.sources = self.spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in self.table], schema)
        self.sizes = rows.join(F.broadcast(self.sources.select("sidx", F.col("source").alias("__s"))), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "source")

    @property
    def pieces(self) -> DataFrame:
        """Two levels of running sums: over the rows of a bucket of a source, and over the buckets of a source."""
        buckets = max(1, self.n_docs // max(1000, self.n_docs // 1_000_000))
        rows = self.sizes.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(self.seed), "doc_id", "row"), F.lit(buckets)))
        sums = rows.groupBy("sidx", "bucket").agg(F.sum("size").alias("s"))
        offset = sums.select("sidx", "bucket", (F.sum("s").over(Window.partitionBy("sidx").orderBy("bucket")) - F.col("s")).alias("base"))
        inner = F.sum("size").over(Window.partitionBy("sidx", "bucket").orderBy("doc_id", "row")) - F.col("size")
        placed = rows.withColumn("inner", inner).join(offset, ["sidx", "bucket"]).withColumn("off", F.col("base") + F.col("inner"))
        n = self.length
        numbers = F.sequence(F.expr(f"off div {n}"), F.expr(f"(off + size - 1) div {n}"))
        first = lambda b: F.greatest(b * n - F.col("off"), F.lit(0))
        last = lambda b: F.least((b + 1) * n - F.col("off"), F.col("size"))
        piece = lambda b: [b.alias("block"), first(b).alias("first"), (last(b) - first(b)).alias("n"), (F.col("off") + first(b) - b * n).alias("at")]
        columns = ["sidx", "p.block", "off", "row", "doc_id", "p.first", "p.n", "p.at"]
        if "text" not in placed.columns:
            return placed.withColumn("p", F.explode(F.transform(numbers, lambda b: F.struct(*piece(b))))).select(*columns)
        # A text is cut into words once; a piece is a range of them with the white space between.
        placed = placed.select("*", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks")).drop("text")
        # explode() would add a filter on the number of pieces, which cuts the text once more.
        pieces = F.transform(numbers, lambda b: F.struct(*piece(b), F.array_join(F.slice("chunks", (first(b) + 1).cast("int"), (last(b) - first(b)).cast("int")), "").alias("part")))
        return placed.withColumn("p", F.explode_outer(pieces)).select(*columns, "p.part")

    @property
    def counts(self) -> DataFrame:
        """Multinomial draws: (shard, sidx, start, n), n draws of the source from its draw ``start`` on.

        Each slot of a shard draws a source by the quotas. What a source draws beyond its quota is given, in the order of
        shards, to sources that fell short, so the draws over all shards meet the quotas.
        """
        edges, sums = [], 0
        for r in self.table:
            sums += r["quota"]
            edges.append(sums)
        slots = self.spark.range(self.total)
        u = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(1), "id"), F.lit(max(1, self.total)))
        drawn = slots.select(F.expr(f"cast(id div {self.shard} as long)").alias("shard"), F.size(F.filter(F.lit(edges), lambda e: e <= u)).alias("sidx"))
        drawn = drawn.groupBy("shard", "sidx").agg(F.count(F.lit(1)).alias("c"))
        quota = F.broadcast(self.sources.select("sidx", "quota"))
        earlier = F.coalesce(F.sum("c").over(Window.partitionBy("sidx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = drawn.join(quota, "sidx").withColumn("start", earlier)
        own = materialize(own.select("shard", "sidx", "c", "quota", "start", F.greatest(F.lit(0), F.least("c", F.col("quota") - F.col("start"))).alias("n")), "drawn")
        got = own.groupBy("sidx").agg(F.sum("n").alias("got"))
        short = self.sources.select("sidx", "quota").join(got, "sidx", "left").fillna(0, ["got"]).withColumn("miss", F.col("quota") - F.col("got")).where("miss > 0")
        by = Window.orderBy("sidx")
        short = short.select("sidx", "got", "miss", (F.sum("miss").over(by) - F.col("miss")).alias("from"))
        over = own.groupBy("shard").agg(F.sum(F.col("c") - F.col("n")).alias("over")).where("over > 0")
        over = over.select("shard", "over", (F.sum("over").over(Window.orderBy("shard")) - F.col("over")).alias("x"))
        # One row a source: the few short sources as one array, matched to each shard's interval of surplus.
        gaps = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in (("sidx", "int"), ("got", "long"), ("miss", "long"), ("from", "long"))]) for r in short.collect()]
        plain = own.where("n > 0").select("shard", "sidx", "start", "n")
        if not gaps:
            return plain
        low, high = F.greatest(F.col("x"), F.col("g.from")), F.least(F.col("x") + F.col("over"), F.col("g.from") + F.col("g.miss"))
        given = over.select("shard", "x", "over", F.explode(F.array(*gaps)).alias("g")).where(high > low)
        return plain.unionByName(given.select("shard", F.col("g.sidx").alias("sidx"), (F.col("g.got") + low - F.col("g.from")).alias("start"), (high - low).alias("n")))

    @property
    def draws(self) -> DataFrame:
        each = self.counts.select("shard", "sidx", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("draw"))
        each = each.join(F.broadcast(self.sources.select("sidx", "n_blocks", "quota", "last", "source_size")), "sidx")
        turn, at, full = F.expr("draw div n_blocks"), F.expr("draw % n_blocks"), F.col("n_blocks") - 1
        block = F.when(at == full, full).otherwise(permuted(at, F.greatest(full, F.lit(1)), F.lit(self.seed), F.col("sidx"), turn))
        words = F.when(F.col("draw") == F.col("quota") - 1, F.col("last")).otherwise(F.lit(self.length))
        return each.select("shard", "sidx", "draw", block.alias("block"), words.cast("long").alias("words"))

    def rows(self) -> DataFrame:
        """The mix by reference: shard, sidx, draw, block and the piece of a document, ``n`` the words that are taken of it."""
        met = self.draws.join(self.pieces, ["sidx", "block"]).where("at < words")
        return met.withColumn("n", F.least("n", F.col("words") - F.col("at")))

    def taken(self) -> DataFrame:
        """Per row of docs: doc_id, size, source_size, target, taken, source."""
        took = self.rows().groupBy("row").agg(F.sum("n").alias("taken"))
        all_rows = self.sizes.join(took, "row", "left").join(F.broadcast(self.sources.select("sidx", "source", "source_size", "target")), "sidx")
        return all_rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

    def blocks(self) -> DataFrame:
        """The mix itself (needs texts=True): shard, slot, source, block, doc_ids, n_words, text. Pieces of several documents stand on
        lines of their own; within a piece white space is as in the document."""
        packed = self.pieces.select("sidx", "block", F.struct("off", "row", "doc_id", "at", "n", "part").alias("p"))
        packed = packed.groupBy("sidx", "block").agg(F.sort_array(F.collect_list("p")).alias("ps"))
        slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed), "sidx", "draw"), "sidx", "draw")) - 1
        placed = self.draws.withColumn("slot", slot)
        named = placed.join(packed, ["sidx", "block"]).join(F.broadcast(self.sources.select("sidx", "source")), "sidx")
        # Only a source's last draw takes a part of a piece.
        cut = lambda p: F.when(p["n"] <= F.col("words") - p["at"], p["part"]).otherwise(F.array_join(F.slice(F.regexp_extract_all(p["part"], F.lit(CHUNK), F.lit(0)), F.lit(1), (F.col("words") - p["at"]).cast("int")), ""))
        taken = named.withColumn("ps", F.filter("ps", lambda p: p["at"] < F.col("words")))
        n_words = F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + F.least(p["n"], F.col("words") - p["at"]))
        return taken.select("shard", "slot", "source", "block", F.col("ps.doc_id").alias("doc_ids"), n_words.alias("n_words"), F.array_join(F.transform("ps", cut), "\n").alias("text"))
