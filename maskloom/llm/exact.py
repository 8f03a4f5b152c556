"""Exact dedup by skew-safe combining (DataFrame functions only).

Three combining steps, each grouping by digest *and* the full normalised text,
so that equal digests alone never merge rows:

1. locally: the map-side partial aggregate leaves one row per text, task and salt;
2. salted: ``(digest, salt)`` groups are merged after the first exchange;
3. globally: the salts' winners of a digest are combined.

A hot text therefore reaches the last step as at most ``salts`` rows. The verdict
then goes back to the rows by an equi-join whose right side is unique, which
adaptive execution splits when the left side is skewed.

Defined results: null text counts as empty; texts equal after deleting ASCII
white space form a group; the row with most code points in its original text
stays, ties go to the smallest id, null ids come last. Rows repeating an id
share its verdict. Empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import named, row_hash

WHITE = " \t\n\x0b\x0c\r"
SALTS = 8
_LAST_ID = 9223372036854775807


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _rank(length: Column, doc_id: Column) -> Column:
    """Length first, then smaller ids, as one decimal: a type that hash aggregation can update in place."""
    wide = "decimal(38,0)"
    behind = F.lit(_LAST_ID).cast(wide) - F.coalesce(doc_id.cast("long"), F.lit(_LAST_ID)).cast(wide)
    ahead = length.cast("decimal(10,0)").cast(wide) * F.lit("100000000000000000000").cast("decimal(21,0)")
    return (ahead + behind).cast(wide)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, guard, chars, keep_id, group_size."""
    rows = docs.select(
        named(id_col).cast("long").alias("id"),
        F.length(F.coalesce(named(text_col).cast("string"), F.lit(""))).alias("len"),
        normalised(named(text_col)).alias("body"),
    ).select(
        "body",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
        _rank(F.col("len"), F.col("id")).alias("rank"),
    )
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    merged = salted.groupBy("digest", "body").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    behind = F.col("rank") % F.lit("100000000000000000000").cast("decimal(21,0)")
    keep = (F.lit(_LAST_ID).cast("decimal(38,0)") - behind).cast("long")
    return merged.select(
        "digest",
        F.xxhash64("body").alias("guard"),
        F.length("body").alias("chars"),
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row with its verdict: id, keep_id, group_size, kept, text_sha256."""
    won = winners(docs, id_col, text_col, salts)
    body = normalised(named(text_col))
    rows = docs.select(
        named(id_col).alias("id"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.xxhash64(body).alias("guard"),
        F.length(body).alias("chars"),
    )
    return rows.join(won, ["digest", "guard", "chars"]).select(
        F.col("id").alias(id_col),
        F.when(F.col("keep_id") == _LAST_ID, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.coalesce(F.col("id").cast("long"), F.lit(_LAST_ID)) == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: one of each group.

    What stays is decided on narrow rows; one join brings the rows themselves. Of rows that
    repeat the id of the row that stays, the longest text and then the smallest hash of all
    columns decides. The joined side is unique by key and narrow, so it is the hashed one.
    """
    won = winners(docs, id_col, text_col, salts).select("digest", F.col("keep_id").alias("keep"))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*map(named, docs.columns)).alias("row"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.coalesce(named(id_col).cast("long"), F.lit(_LAST_ID)).alias("keep"), F.length(text).alias("len"), row_hash(docs).alias("tie"))
    # the join leaves rows dealt by (digest, keep), so ranking them shuffles nothing more
    order = Window.partitionBy("digest", "keep").orderBy(F.desc("len"), "tie")
    stay = keyed.join(won.hint("shuffle_hash"), ["digest", "keep"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1)
    return stay.select("row.*")
