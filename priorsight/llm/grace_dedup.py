"""Exact dedup by Grace hashing: records are dealt to spill files until each bucket fits a table that compares whole contents.

The recursion runs over sixteen bytes a distinct hash: buckets that weigh more than a table holds are parted by the next
hash function, and so on until all fit or hold one hash.  The records then go once, to the shuffle file of their last
bucket, so the spill files are Spark's own and outlive a lost executor.  A task puts its bucket into an open-addressing
table whose slots compare complete contents.  Contents that alone outweigh a bucket never go there (``heavy.part``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.llm.heavy import HEAVY, SENT, part
from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import as_bytes
from priorsight.plans.lineage import cut

#: Bytes of content, and 256 a row, that a bucket should hold; one of more than twice as many is parted again.
BUCKET = 1 << 24
SPACE = " \t\n\x0b\x0c\r"
_RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _numbered(contents: list[bytes], hashes: list[int]) -> tuple[list[int], list[int]]:
    """The group of each content, and each group's first row: linear probing, a slot matches if hash and all bytes do."""
    bits = max(3, (2 * len(contents)).bit_length())
    mask = (1 << bits) - 1
    slots = [-1] * (mask + 1)
    group, first = [], []
    for row, (content, h) in enumerate(zip(contents, hashes)):
        at = h & mask
        while (found := slots[at]) >= 0 and not (hashes[first[found]] == h and contents[first[found]] == content):
            at = (at + 1) & mask
        if found < 0:
            slots[at] = found = len(first)
            first.append(row)
        group.append(found)
    return group, first


def _deduplicated(key: tuple, bucket: pa.Table) -> pa.Table:
    contents = as_bytes(bucket["content"])
    group, first = _numbered(contents, bucket["hash"].to_pylist())
    chars, ids = bucket["chars"].to_pylist(), bucket["id"].to_pylist()
    best = list(first)
    for row, g in enumerate(group):
        # Most code points, then the smallest id; rows without an id come last.
        mine, other = (-chars[row], ids[row] is None, ids[row]), (-chars[best[g]], ids[best[g]] is None, ids[best[g]])
        if mine[:2] < other[:2] or (mine[:2] == other[:2] and not mine[1] and mine[2] < other[2]):
            best[g] = row
    sizes = np.bincount(group, minlength=len(first)).tolist()
    digests = [hashlib.sha256(contents[f]).hexdigest() for f in first]
    keep = [ids[best[g]] for g in group]
    return pa.table({
        "row": bucket["row"],
        "keep_id": pa.array(keep, bucket.schema.field("id").type),
        "group_size": pa.array([sizes[g] for g in group], pa.int64()),
        "kept": pa.array([chars[best[g]] == c and k == i for g, c, k, i in zip(group, chars, keep, ids)], pa.bool_()),
        "text_sha256": pa.array([digests[g] for g in group], pa.string()),
    })


def _buckets(weights: DataFrame, size: int):
    """A function that adds ``bucket`` to rows with ``hash``: parted anew, level by level, while a bucket weighs more than two of ``size``."""
    total = weights.agg(F.sum("weight")).first()[0] or 0
    levels: list[DataFrame] = []

    def deal(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("bucket", F.pmod("hash", F.lit(total // size + 1)))
        for level, large in enumerate(levels, 1):
            anew = F.xxhash64("bucket", F.pmod(F.xxhash64("hash", F.lit(level)), F.col("parts")))
            rows = rows.join(F.broadcast(large), "bucket", "left").withColumn("bucket", F.when(F.col("parts").isNotNull(), anew).otherwise(F.col("bucket"))).drop("parts")
        return rows

    while True:
        sizes = deal(weights).groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("hashes"))
        large = sizes.filter((F.col("weight") > 2 * size) & (F.col("hashes") > 1))
        # At most one for every two of ``size`` in the table: sixteen bytes for each 32 MB.
        large = cut(large.select("bucket", (F.col("weight") / size + 1).cast("long").alias("parts")))
        if large.isEmpty():
            return deal
        levels.append(large)


def deduplicate(docs: DataFrame, columns: Sequence[str] | None = None, content: Column | None = None, bucket: int = BUCKET, heavy: int = HEAVY, sent: int = SENT) -> DataFrame:
    """``columns`` of ``docs`` (all, if none are named) with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, a row for every row.

    Rows are equal if their ``content`` is, byte for byte: by default ``text`` without ASCII white space.  Of equal rows the one with the
    most code points in ``text`` stays, then the one with the smallest ``doc_id``; one without an id stays only where no other has so many.
    Null text counts as empty, so all null and blank texts are one group.  Rows that repeat the ``doc_id`` and length of the one that stays
    are the same document and kept with it; of rows without an id likewise (``keep_id`` null).  An empty table gives no rows.
    Columns of the four names are replaced; others may have any name.
    """
    docs = docs.drop(*_RESULT)
    columns = [c for c in docs.columns if c in columns] if columns is not None else docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.translate(text, SPACE, "") if content is None else content
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), F.length(text).alias("chars"), F.coalesce(content, F.lit("")).alias("content")
    )
    parted = part(rows, max(heavy, 1), sent)
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("keep_id", rows.schema["id"].dataType)])
    out = out.add("group_size", T.LongType()).add("kept", T.BooleanType()).add("text_sha256", T.StringType())
    light = _buckets(parted.weights, bucket)(parted.light).groupBy("bucket").applyInArrow(_deduplicated, out)
    first = F.min(F.struct((-F.col("chars")).alias("most"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("keep_id"))).alias("first")
    groups = parted.heavy.groupBy("hash").agg(first, F.count(F.lit(1)).alias("group_size"))
    digests = parted.pivots.select("hash", F.sha2("content", 256).alias("text_sha256"))
    # One row for each heavy hash, of which there are HEAVIEST at most.
    named = F.broadcast(cut(groups.join(digests, "hash")))
    kept = F.col("id").eqNullSafe(F.col("first.keep_id")) & (F.col("chars") == -F.col("first.most"))
    many = parted.heavy.join(named, "hash").select("row", F.col("first.keep_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
    return light.union(many).select("row.*", *_RESULT)


@query(
    "op12_grace_dedup",
    """with t as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as content from documents),
k as (select doc_id, content, first_value(doc_id) over (partition by content order by chars desc, doc_id) as keep_id, count(*) over (partition by content) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256 from k""",
)
def op12_grace_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the one of equal text that stays."""
    return deduplicate(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
