"""Exact dedup by skew-safe combining, in DataFrame operations only.

Every stage groups by (digest, whole normalised text), so equality is always decided on
content and the digest only routes rows:

1. local: map-side partial aggregation leaves one row per text and input partition;
2. salted: rows of one text meet in at most ``salts`` groups, chosen by input partition;
3. global: the salt winners of a digest (``salts`` rows a text at most) are combined.

The decision table (digest, keep_id, group_size) is written to the shared folder and joined
back by digest; a digest that holds two different texts (a SHA-256 collision) takes a second
join on the text itself. A hot text thus never meets in one task: the last join only sees
(doc_id, digest) rows, which adaptive execution splits when they are skewed.

Defined results: null text counts as empty; empty texts are equal to one another; a null
doc_id loses against any other and stays only if its whole group has none; rows that repeat
one doc_id and text all count in ``group_size`` and share the flag ``kept``; an empty table
gives no rows. Columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.llm.common import LOWER, UPPER, ascii_lower, cut, table


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text).alias("norm")).withColumn("digest", F.sha2("norm", 256))


def decisions(rows: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, keep_id, group_size, clash) per distinct text of ``rows`` (doc_id, norm, digest).

    ``clash`` is the text itself where several texts share a digest, else null.
    """
    dealt = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = dealt.groupBy("digest", "norm", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # at most `salts` rows a text are left, so one text is no hot key here
    winners = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return winners.withColumn("n_texts", texts).select("digest", "keep_id", "group_size", F.when(F.col("n_texts") > 1, F.col("norm")).alias("clash"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256; see the module's text."""
    rows = normalised(docs, id_col, text_col)
    decided = cut(decisions(rows, salts), "exact-dedup")
    single = decided.filter(F.col("clash").isNull()).drop("clash")
    out = rows.select("doc_id", "digest").join(single, "digest")
    if not decided.filter(F.col("clash").isNotNull()).isEmpty():
        several = decided.filter(F.col("clash").isNotNull()).withColumnRenamed("digest", "other")
        same = (F.col("digest") == F.col("other")) & (F.col("norm") == F.col("clash"))
        out = out.unionByName(rows.join(several, same).select("doc_id", "digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of every group of equal texts.

    Rows are joined to the decisions by digest and id together, so the copies of a hot text
    spread over all tasks. Only rows whose id and text both repeat are compared once more: the
    first of them by their JSON text stays; whole rows are shuffled for these alone.
    """
    decided = cut(decisions(normalised(docs, id_col, text_col), salts), "exact-dedup", lean=True).select(F.col("digest").alias("__stay_digest"), F.col("keep_id").alias("__stay_id"))
    columns = docs.columns
    marked = docs.withColumn("__own_digest", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    stays = (marked["__own_digest"] == decided["__stay_digest"]) & marked[id_col].eqNullSafe(decided["__stay_id"])
    kept = marked.join(decided, stays, "left_semi")
    counted = marked.groupBy(F.col("__own_digest").alias("__again_digest"), F.col(id_col).alias("__again_id")).agg(F.count(F.lit(1)).alias("n"))
    again = cut(counted.filter("n > 1").drop("n"), "rows-repeated", lean=True)
    if again.isEmpty():
        return kept.select(*columns)
    same = (F.col("__own_digest") == F.col("__again_digest")) & F.col(id_col).eqNullSafe(F.col("__again_id"))
    place = F.row_number().over(Window.partitionBy("__own_digest", id_col).orderBy(F.to_json(F.struct(*[F.col(c) for c in columns]))))
    first = kept.join(again, same, "left_semi").withColumn("__place", place).filter("__place = 1")
    return kept.join(again, same, "left_anti").select(*columns).unionByName(first.select(*columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
