"""WARC fixity: records and their ordered offset ranges are hashed into trees, replicas compare roots, and only branches that
differ are followed down to the records that are corrupt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Children of a node.
FANOUT = 16


def warc_records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) as WARC response records: file, page_id, url, record (bytes), length, record_sha256.

    A file holds the pages of ``per_file`` consecutive ids; those without an id are dealt over 1,024 files of negative numbers by their
    contents. Null urls and bodies are empty. Repeated pages are records each. placed() gives records their places.
    """
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.expr(f"floor(page_id / {per_file})"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1024)))
    rows = pages.select(file.cast("long").alias("file"), "page_id", "url", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))
    return rows.withColumns({"length": F.octet_length("record").cast("long"), "record_sha256": F.sha2("record", 256)})


def placed(rows: DataFrame) -> DataFrame:
    """seq and offset of records by page_id (ties by their digest) inside each file. Leave the records out before: only lengths and
    digests are needed, and bodies would go through the shuffle."""
    by = Window.partitionBy("file").orderBy("page_id", "record_sha256")
    return rows.withColumn("seq", F.row_number().over(by) - 1).withColumn("offset", F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def read_warc(files: DataFrame) -> DataFrame:
    """Records of files read with ``spark.read.format('binaryFile')``: path, offset, length, record_id, url, body."""

    def parse(batches):
        import pandas as pd

        for part in batches:
            for path, data in zip(part["path"], part["content"], strict=True):
                rows, at, data = [], 0, bytes(data)
                while (start := data.find(b"WARC/", at)) == at and at < len(data):
                    head_end = data.index(b"\r\n\r\n", start) + 4
                    fields = dict(x.split(b": ", 1) for x in data[start:head_end].split(b"\r\n")[1:] if b": " in x)
                    end = head_end + int(fields[b"Content-Length"])
                    at = end + 4
                    rows.append((path, start, at - start, fields.get(b"WARC-Record-ID", b"").decode(), fields.get(b"WARC-Target-URI", b"").decode(), data[head_end:end]))
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "record_id", "url", "body"])

    return files.select("path", "content").mapInPandas(parse, "path string, offset long, length long, record_id string, url string, body binary")


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Writes one WARC file for each file of ``records`` (file, offset, record) under ``path``, any that pyarrow can open, and returns
    file, path, length. A file's records go to one task, which writes them one after the other; a repeated task writes the same."""

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(top)
        out, at, rows = None, None, []
        for part in batches:
            for file, record in zip(part["file"], part["record"], strict=True):
                if file != at:
                    if out:
                        out.close()
                    at, name = file, f"{top}/{file}.warc"
                    out = store.open_output_stream(name)
                    rows.append([file, name, 0])
                out.write(bytes(record))
                rows[-1][2] += len(record)
        if out:
            out.close()
        yield pd.DataFrame(rows, columns=["file", "path", "length"])

    ordered = records.select("file", "offset", "record").repartition("file").sortWithinPartitions("file", "offset").select("file", "record")
    return materialize(ordered.mapInPandas(write, "file long, path string, length long"), "written")


def leaf(record_sha256: Column, offset: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("leaf"), offset.cast("string"), record_sha256), 256)


def tree(leaves: DataFrame, key: str = "file") -> tuple[list[DataFrame], int]:
    """The levels, and the number of the top one: key, level, node, digest of every node above (key, seq, digest) leaves: level 0 are the leaves, the top has node 0.

    A node's digest covers the digests of up to FANOUT children in their order, so no group is larger than that. The number
    of levels follows from the longest file.
    """
    level = leaves.select(key, F.lit(0).alias("level"), F.col("seq").cast("long").alias("node"), "digest")
    every, top = [level], leaves.agg(F.max("seq")).first()[0] or 0
    n = 0
    while top > 0:
        n, top = n + 1, top // FANOUT
        child = F.struct(F.col("node").alias("i"), "digest")
        level = level.groupBy(key, F.expr(f"node div {FANOUT}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        level = level.select(key, F.lit(n).alias("level"), F.col("up").alias("node"), F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["i"].cast("string"), x["digest"]))), 256).alias("digest"))
        level = materialize(level, "level")
        every.append(level)
    return every, n


def audit(one: DataFrame, two: DataFrame, key: str = "file") -> DataFrame:
    """key, seq, found ('changed', 'missing' in two, 'added' in two) of leaves that differ between two replicas' (key, seq, digest).

    Roots of files are compared first; each further level only joins the children of nodes that differed.
    """
    left, n = tree(one, key)
    right, m = tree(two, key)
    while n < m:
        left, n = [*left, _lifted(left[-1], n + 1, key)], n + 1
    while m < n:
        right, m = [*right, _lifted(right[-1], m + 1, key)], m + 1
    open_nodes = None
    for level in range(n, -1, -1):
        a, b = left[level], right[level]
        if open_nodes is not None:
            a, b = (x.withColumn("up", F.expr(f"node div {FANOUT}")).join(open_nodes, [key, "up"], "left_semi").drop("up") for x in (a, b))
        both = a.select(key, "node", F.col("digest").alias("x")).join(b.select(key, "node", F.col("digest").alias("y")), [key, "node"], "full").where("not (x <=> y)")
        both = materialize(both, "differ")
        open_nodes = both.select(key, F.col("node").alias("up"))
    return both.select(key, F.col("node").alias("seq"), F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").otherwise("changed").alias("found"))


def _lifted(level: DataFrame, n: int, key: str) -> DataFrame:
    """A further level of one node a file above a lone top node."""
    return level.select(key, F.lit(n).alias("level"), F.lit(0).cast("long").alias("node"), F.sha2(F.concat(F.lit("0:"), "digest"), 256).alias("digest"))


def replica_report(records: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of ``records`` (file, seq, page_id, offset, length, record_sha256): these and intact.

    ``replica`` has (file, seq, offset, record_sha256); what it adds beyond ``records`` is left out here and is in audit().
    """
    digest = leaf(F.col("record_sha256"), F.col("offset")).alias("digest")
    mine = materialize(records.select("file", "seq", "page_id", "offset", "length", "record_sha256", digest), "leaves")
    bad = audit(mine.select("file", "seq", "digest"), materialize(replica.select("file", "seq", digest), "leaves")).where("found <> 'added'")
    return mine.join(bad, ["file", "seq"], "left").select("page_id", "file", F.col("seq").cast("long").alias("seq"), "offset", "length", "record_sha256", F.col("found").isNull().alias("intact"))
