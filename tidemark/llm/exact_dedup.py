"""Exact deduplication by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, durable, join_spread, numbered

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text compared: null is empty, every ASCII white-space character deleted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays, then the smallest id. Null texts count
    as empty, so null, empty and all-blank texts form one group. Other columns of ``docs`` are ignored, whatever their
    names; an empty table gives no rows; rows that repeat an id count as separate rows of their group and each is
    returned (all of them ``kept`` if the id stays). Ids are numbers.

    Texts travel once, after equal ones have been merged within each task: grouping by (hash, text) compares bytes, so
    different texts under one 128-bit hash stay apart, told from each other by their SHA-256. Only hashes, lengths and
    ids move otherwise. Hot groups are merged before each shuffle, and their rows find what stays without a shuffle.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("_cp"))
    base = base.select("_id", "_norm", "_cp", F.md5("_norm").alias("_h128"), F.sha2("_norm", 256).alias("_sha"))
    texts = (
        base.groupBy("_h128", "_sha", "_norm")
        .agg(F.count("*").alias("_n"))
        .groupBy("_h128", "_sha")
        .agg(F.sum("_n").alias("group_size"), F.count("*").alias("_texts"))
        .select("_h128", "_sha", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error("two texts share MD5 and SHA-256").cast("bigint")).alias("group_size"))
    )
    digests = durable(base.select("_id", "_cp", "_h128", "_sha"))
    best = digests.groupBy("_h128", "_sha").agg(F.max(F.struct(F.col("_cp"), (-F.col("_id")).alias("_neg"))).alias("_best"))
    groups = durable(texts.join(best, ["_h128", "_sha"]).select("_h128", "_sha", "group_size", (-F.col("_best._neg")).alias("keep_id")))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    joined = join_spread(digests.select("_id", "_h128", "_sha"), groups, ["_h128", "_sha"], "group_size", total)
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_first_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, by the order of ``exact_duplicates``; all columns stay.

    Rows without an id (a number) come after those with one; of rows that are alike in id and length too, any one stays.
    """
    rows = numbered(docs)
    norm = normalised(F.col(text_col))
    order = F.struct(F.coalesce(F.char_length(text_col), F.lit(0)).alias("_cp"), (-F.col(id_col)).alias("_neg"), ROW)
    base = rows.select(F.md5(norm).alias("_h128"), F.sha2(norm, 256).alias("_sha"), norm.alias("_norm"), order.alias("_best"))
    texts = base.groupBy("_h128", "_sha", "_norm").agg(F.max("_best").alias("_best")).groupBy("_h128", "_sha").agg(F.max("_best").alias("_best"), F.count("*").alias("_texts"))
    kept = texts.select(F.when(F.col("_texts") == 1, F.col(f"_best.{ROW}")).otherwise(F.raise_error("two texts share MD5 and SHA-256").cast("bigint")).alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
