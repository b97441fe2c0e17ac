"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each round asks for less than the last one. A document whose length nobody
shares is unique; of the others, one whose length and prefix hash nobody shares
is; only what is left is hashed whole. What a round leaves over reaches the
next scan as a bitmap, sized from a count of its keys up to a fixed bound: a
hash collision there costs one hash too many, never a wrong result. All of it
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.llm.common import KeyBitmap, Scratch, skew_join

#: Characters under the prefix hash.
PREFIX_CHARS = 64


def _repeated(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*keys.columns).count().where("count > 1").drop("count")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size and kept.

    Texts are equal when identical; a null text counts as empty. Of equal texts
    the row with the largest id stays. Rows that repeat an id and its text stay
    or go together, and count one by one in group_size. A null id is smaller
    than any other; if all ids of a group are null, all its rows stay. An empty
    table gives an empty one. Columns of docs named keep_id, group_size or kept
    are replaced; other columns pass through.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    prefix = F.xxhash64(F.substring(text, 1, PREFIX_CHARS))
    with Scratch(docs.sparkSession) as own:
        keyed = docs.withColumn("_len", F.octet_length(text))
        lengths = KeyBitmap(_repeated(keyed.select("_len")), own)
        second = lengths.mark(keyed, "_long")
        prefixes = KeyBitmap(_repeated(second.where("_long").select("_len", prefix.alias("_prefix"))), own)
    third = prefixes.mark(second.withColumn("_prefix", F.when(F.col("_long"), prefix)), "_alive")
    full = third.withColumn("_full", F.when(F.col("_long") & F.col("_alive"), F.sha2(text, 256))).drop("_len", "_long", "_prefix", "_alive")

    alone = full.where("_full is null").select("*", F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    candidates = full.where("_full is not null")
    groups = candidates.groupBy("_full").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = skew_join(candidates, groups, "_full").withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return alone.unionByName(joined).drop("_full")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs. See mark_copies for the cases."""
    return mark_copies(docs, id_col, text_col).where("kept").select(*[f"`{c}`" for c in docs.columns])
