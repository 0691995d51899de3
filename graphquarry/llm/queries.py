"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fixity, line_dedup, lm_score, mixing, pii, quality, secret_scan
from . import ngram_join, suffix_dedup
from .common import materialize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.Mix(_read(spark, sf_dir, "documents")).taken()


def op2_ngram_jaccard(spark, sf_dir):
    return ngram_join.linked_components(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op4_lm_scoring(spark, sf_dir):
    return lm_score.pseudo_likelihood(_read(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_bytes(_read(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.quality_report(_read(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.pii_report(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op10_warc_fixity(spark, sf_dir):
    """The audit of a replica in which every 97th page has one byte changed and every 211th is missing.

    The replica's damage follows from page_id alone, so SQL can tell what must be found.
    """
    records = fixity.warc_records(_read(spark, sf_dir, "pages"))
    changed = F.when(F.col("page_id") % 97 == 5, F.overlay("record", F.lit(b"#"), 1)).otherwise(F.col("record"))
    placed = materialize(fixity.placed(records.withColumn("found_sha256", F.sha2(changed, 256)).drop("record", "url")), "placed")
    replica = placed.where("page_id % 211 <> 7").select("file", "seq", "offset", F.col("found_sha256").alias("record_sha256"))
    return fixity.replica_report(placed, replica)


_OP10 = """
with r as (select page_id, cast(floor(page_id / 1000.0) as bigint) as file,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages)
select page_id, file, row_number() over (partition by file order by page_id) - 1 as seq,
  cast(sum(strlen(record)) over (partition by file order by page_id) - strlen(record) as bigint) as "offset", cast(strlen(record) as bigint) as length,
  sha256(record) as record_sha256, page_id % 97 <> 5 and page_id % 211 <> 7 as intact from r
"""


def queries():
    named = (op1_mixing, op2_ngram_jaccard, op3_decontamination, op4_lm_scoring, op5_secret_scan, op6_suffix_dedup, op7_quality, op8_pii, op9_line_dedup, op10_warc_fixity)
    return {f.__name__: f for f in named}


def oracle_sql():
    return {"op10_warc_fixity": _OP10}
