"""Exact duplicates by progressive refinement, in DataFrame operations only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import dealt, hot_from, settle

PREFIX = 64  # characters under the prefix hash
LENGTHS = 1_000_000  # lengths, and then prefixes, that are broadcast at most; beyond, their test is passed by every text


def refined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple = ()) -> DataFrame:
    """One settled row per row of docs: id, len (bytes), head, full, carried.

    head is a hash of the first PREFIX characters, null where no other text has that length; full is the SHA-256 of the
    text, null where no other text has that length and head. Both are computed where the text is scanned, so no text is
    shuffled: the lengths, and the heads, that several texts share are broadcast behind a check of their number.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    carried = F.struct(F.lit(0).alias("_"), *carry).alias("carried")
    rows = docs.select(F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("len"), text.alias("text"), carried)

    lengths = settle(rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "lengths")
    head = F.xxhash64(F.substring("text", 1, PREFIX))
    if lengths.count() <= LENGTHS:
        several = F.broadcast(lengths.withColumn("several", F.lit(True)))  # its size is checked
        rows = rows.join(several, "len", "left").withColumn("head", F.when(F.col("several"), head)).drop("several")
    else:
        rows = rows.withColumn("head", head)

    heads = settle(rows.where("head is not null").groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1").select("len", "head"), "heads")
    full = F.sha2("text", 256)
    if heads.count() <= LENGTHS:
        several = F.broadcast(heads.withColumn("several", F.lit(True)))  # its size is checked
        rows = rows.join(several, ["len", "head"], "left").withColumn("full", F.when(F.col("several"), full))
    else:
        rows = rows.withColumn("full", full)
    return settle(rows.select("id", "len", "head", "full", "carried"), "rows")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple = ()) -> DataFrame:
    """One row per row of docs: id, keep_id (the largest id among rows of that very text), group_size, kept, then the
    columns of docs that carry names.

    Rows are grouped by length, those that share it by a hash of their first PREFIX characters, and only of those that
    share both is the full text read again and hashed (see refined).

    Null counts as empty. Rows with a null id count in group_size and have null in kept; keep_id is null if all of a
    group's ids are. A repeated row counts and is returned as often as it occurs; rows of different texts under one id
    are judged each by its own text. Other columns are not looked at. An empty table gives an empty result.
    """
    rows, key = refined(docs, id_column, text_column, carry), ["len", "full"]
    groups = settle(rows.where("full is not null").groupBy(*key).agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1"), "groups")
    least = hot_from(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    found = dealt(rows, groups, key, least, "left").select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "carried")
    return found.select("id", "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), *(F.col("carried")[c].alias(c) for c in carry))


def exact_query(docs: DataFrame) -> DataFrame:
    """op4: beside the refinement, which doesn't use it, the digest of every text that the result shows."""
    digests = docs.select("doc_id", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    return exact_duplicates(digests, carry=("text_sha256",)).withColumnRenamed("id", "doc_id")


EXACT_SQL = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
