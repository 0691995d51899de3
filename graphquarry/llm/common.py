"""Helpers shared by the operators: shared storage, byte-level hashing, graph components.

Texts cross into Python as UTF-8 bytes (``cast('binary')``), so white space and ASCII case have one meaning everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: \x20 and \x09-\x0D.
SPACE_CODES = (9, 10, 11, 12, 13, 32)
#: Java regex of a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset, which
    only a local master shares with its executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or f"{tempfile.gettempdir()}/graphquarry-{spark.sparkContext.applicationId}").rstrip("/")


#: Rows that go to Python at a time: ten thousand texts, Spark's own number, take many MB in the JVM and again in Python.
ROWS_A_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends ROWS_A_BATCH rows at a time to Python, or fewer where it is set so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_A_BATCH:
        spark.conf.set(key, str(ROWS_A_BATCH))


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark deletes the shuffle files of a finished job once its driver has collected the plan, which may otherwise take hours.
    spark._jvm.System.gc()
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def stored_files(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that is no longer read."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def vectorized(returns):
    """A pandas UDF that is made when it is used: parsing its type needs a session, importing a module doesn't."""
    return lambda f: lambda *columns: F.pandas_udf(f, returns)(*columns)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def if_short(df: DataFrame, lists: str, elements: int) -> DataFrame:
    """As if_small(), by the number of elements in a column of lists and of rows, for rows that have no bounded width."""
    total = df.agg(F.sum(F.size(lists) + F.lit(1))).first()[0] or 0
    return F.broadcast(df) if total <= elements else df


def trim() -> None:
    """Give back the memory that a Python worker has freed; Spark keeps workers, and each would hold on to its largest batch."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """As trim(), for the driver's JVM: what it compiles, compresses and plans for each query leaves hundreds of MB of freed memory with
    its allocator. A JVM that can't (before 17.0.9, or not on Linux) keeps it."""
    java, new = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError, TypeError):
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(java.Object, 4)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only where a count of ``df`` (a stored table) is at most ``rows``; otherwise Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- hashing -------------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _cache[name] = have
    return have


def byte_table() -> np.ndarray:
    if "bytes" not in _cache:
        _cache["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _cache["bytes"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of data[i:j] times base**i (mod 2**64)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table()[data] * _powers("pow", _BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes anywhere."""
    return mix((prefix[end] - prefix[start]) * _powers("inv", _INV, len(prefix))[start])


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't separators (a table of 256 booleans)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def separators(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


SPACES = separators(SPACE_CODES)


def words_hashed(raw: bytes, separator: np.ndarray = SPACES) -> np.ndarray:
    """A 64-bit hash for each word of ``raw``, A-Z lower-cased."""
    data = np.frombuffer(raw.lower(), np.uint8)
    start, end = word_spans(data, separator)
    return span_hash(prefix_hash(data), start, end) if len(start) else np.empty(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; none where there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # The words' hashes are mixed already, so a sum with one odd factor for each place keeps grams apart.
    acc, factor = words[:n] * np.uint64(_BASE), _BASE
    for j in range(1, k):
        factor = factor * _BASE & _MASK
        acc += words[j : n + j] * np.uint64(factor)
    return mix(acc)


# --- components ----------------------------------------------------------------------------------------------------


#: Tables of so many nodes go to every executor, so that a round's joins shuffle nothing.
FEW_NODES = 100_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the edges: component is the smallest node that links reach.

    Contraction: each round a node goes to the smallest of itself and its neighbours, and its links with it; those inside a node end. Nodes
    are hashes, so their order is random, and of a chain's nodes half stay in a round, of a hub's fewer: rounds grow with the
    logarithm of the nodes, whatever the links. The rounds' tables, each smaller than the one before, are then followed from
    the last one back. A node with very many links only costs rows of its own joins, which adaptive execution splits, and minima,
    which are combined before the shuffle.
    """
    left = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    rounds = []
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "rounds")
        few = to.limit(FEW_NODES + 1).count() <= FEW_NODES
        rounds.append((to, few))
        end = lambda x, to=to, few=few: _hinted(to.select(F.col("node").alias(x), F.col("component").alias(f"{x}_to")), few)
        new = materialize(left.join(end("u"), "u").join(end("v"), "v").where("u_to <> v_to").select(F.col("u_to").alias("u"), F.col("v_to").alias("v")), "links")
        stored_files(left)
        left = new
        if left.isEmpty():
            break
    found, few = rounds[-1]
    for to, more in rounds[-2::-1]:
        last = _hinted(found.select(F.col("node").alias("at"), F.col("component").alias("low")), few)
        found, few = to.join(last, to.component == F.col("at"), "left").select("node", F.coalesce("low", "component").alias("component")), more
    if len(rounds) > 1:
        found = materialize(found, "labels")
        for to, _ in rounds:
            stored_files(to)
    stored_files(left)
    return found


def _hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df
