"""Exact dedup: group by 128-bit content hash, keep one stable id, compare bytes inside groups.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null
text counts as empty.  Of equal texts the row with the most code points in its original text
stays, then the smallest id (a null id is the largest).  Rows that repeat an id are rows of
their own: they count in ``group_size``, and of those that tie one stays.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, small, table

BLANKS = " \t\n\x0b\x0c\r"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Only hashes move for unique texts.  The texts of groups of two or more are compared byte
    for byte as grouping keys, with map-side combine, so a group that holds a third of all
    rows shrinks to one row a task before it is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.translate(text, BLANKS, "").alias("norm"), F.char_length(text).alias("n_cp"))
    rows = rows.withColumns({"h": F.unhex(F.md5(F.col("norm").cast("binary"))), "order": F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")})
    digests = saved(rows.select("doc_id", "n_cp", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-digests")

    repeated = saved(digests.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact-repeated")
    same = rows.join(small(repeated, 64), "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    same = same.select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "n", F.col("first.doc_id").alias("keep_id"))
    # Different bytes with one md5 part here by their sha256; should both hashes ever agree, stop.
    groups = same.groupBy("h", "sha").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("keep_id").alias("keep_id"))
    groups = saved(groups.select("h", "sha", "n", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share md5 and sha256"))).otherwise(F.col("keep_id")).alias("keep_id")), "exact-groups")

    # rows of one text that have one id, or none: the row that stays for the id
    tied = digests.groupBy("h", "sha", "doc_id").agg(F.count("*").alias("rows"), F.min(F.struct((-F.col("n_cp")).alias("less"), "row")).alias("one")).where("rows > 1")
    tied = saved(tied.select("h", "sha", F.col("doc_id").alias("of_id"), F.col("one.row").alias("one")), "exact-tied")

    found = digests.join(groups, ["h", "sha"], "left")
    if tied.limit(1).count():
        found = found.join(tied, (found["h"] == tied["h"]) & (found["sha"] == tied["sha"]) & found["doc_id"].eqNullSafe(tied["of_id"]), "left").select(found["*"], "one")
    else:
        found = found.withColumn("one", F.lit(None).cast("long"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("doc_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (keep.eqNullSafe(F.col("doc_id")) & (F.col("one").isNull() | (F.col("one") == F.col("row")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER same AS keep_id, row_number() OVER same AS nth, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW same AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
