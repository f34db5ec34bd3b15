"""Substring dedup: every window of words hashed, hashes counted over the whole corpus, repeated windows removed.

Texts are dealt to batches of a few MB by a hash of the row.  A batch computes
the Rabin-Karp hash of each of its windows, drops repeats within itself and
sends the rest, packed by hash bucket, to be counted: a bucket finds the hashes
that came from two batches or more and answers each batch with one bit a hash.
The batch then joins the repeated windows into maximal intervals and cuts them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import _Powers, as_bytes, rolling, word_hashes

WINDOW = 35
#: Bytes of text in a batch, and of text behind a bucket, on average.
BATCH, BUCKET = 1 << 21, 1 << 23
_FIRST, _SECOND = _Powers(0xC2B2AE3D27D4EB4F | 1), _Powers(0x165667B19E3779F9 | 1)


def _windows(texts: list[bytes], width: int, buckets: int):
    """Of a batch: text borders in words, each window's first word, its place among the distinct hashes, and these.

    The distinct (bucket, hash) are sorted, so they and their order depend on nothing but the batch's texts.
    """
    words, borders = word_hashes(texts)
    hashes = rolling(words, width, _FIRST)
    bucket = (rolling(words, width, _SECOND) % np.uint64(buckets)).astype(np.int32)
    inside = np.ones(len(hashes), bool)
    for end in borders[1:-1]:  # windows that begin in one text and end in another
        inside[max(0, end - width + 1) : end] = False
    first = np.flatnonzero(inside)
    hashes, bucket = hashes[first], bucket[first]
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    h, b = hashes[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return borders, first, place, b[new], h[new]


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))


def _short(batches):
    """Texts of fewer words than a window, as they stay."""
    for batch in batches:
        words = [t.split() for t in as_bytes(batch["text"])]
        yield pa.record_batch({
            "row": batch["row"],
            "n_words": pa.array([len(w) for w in words], pa.int64()),
            "n_removed": pa.array([0] * len(words), pa.int64()),
            "removed": pa.array([[] for _ in words], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            "kept": pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string()),
        })


def remove_repeats(docs: DataFrame, width: int = WINDOW, spread: Sequence[Column] = ()) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with ``n_words``, ``n_removed``, ``removed`` and ``kept``.

    A word goes if a window of ``width`` words over it has a word sequence that starts anywhere else too, in the
    same text or another; all copies go, and windows are judged on the input.  ``removed`` lists the maximal
    intervals [first, last) of words; ``kept`` is the rest joined by single spaces.

    Null texts have no words and an empty ``kept``; texts of fewer than ``width`` words lose nothing; repeated
    rows repeat each other's windows; an empty table gives no rows.  Columns of those four names are replaced.
    Texts of at least ``width`` words are dealt to batches by text, ``doc_id`` if there is such a column, and the columns
    ``spread``, which should tell rows with one text apart; the others are not dealt at all.
    Two window sequences count as equal if 64 bits and the bucket from another hash agree.
    """
    own = ("n_words", "n_removed", "removed", "kept")
    docs = docs.drop(*own)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, buckets = size // BATCH + 1, size // BUCKET + 1
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Split no further than the width, so that long texts cost no more than their first words.
    space = " \t\n\x0b\x0c\r"
    windowed = F.coalesce(F.size(F.split(F.trim("text", F.lit(space)), f"[{space}]+", width)) >= width, F.lit(False))
    if width < 2:
        windowed = F.lit(True)
    keys = [F.col(f"`{c}`") for c in docs.columns if c == "doc_id"]
    dealt = docs.filter(windowed).select(F.pmod(F.xxhash64("text", *keys, *spread), F.lit(batches)).alias("batch"), "text", rows)
    short = docs.filter(~windowed).select("text", rows)

    def send(key: tuple, part: pa.Table) -> pa.Table:
        _, _, _, bucket, hashes = _windows(as_bytes(part["text"]), width, buckets)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts[1:], len(bucket))
        return pa.table({
            "batch": pa.array([key[0].as_py()] * len(starts), pa.int64()),
            "bucket": pa.array(bucket[starts], pa.int32()),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        })

    def answer(key: tuple, part: pa.Table) -> pa.Table:
        packed = part["hashes"].to_pylist()
        lengths = np.array([len(p) // 8 for p in packed])
        hashes = np.frombuffer(b"".join(packed), np.uint64)
        order = np.argsort(hashes)
        same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        seen = np.zeros(len(hashes), bool)
        seen[order[same]] = seen[order[same + 1]] = True
        ends = np.cumsum(lengths)
        mine = [np.packbits(seen[e - n : e]) for e, n in zip(ends, lengths)]
        hit = [i for i, bits in enumerate(mine) if bits.any()]
        return pa.table({
            "batch": part["batch"].combine_chunks().take(pa.array(hit, pa.int64())),
            "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()),
            "seen": pa.array([mine[i].tobytes() for i in hit], pa.binary()),
        })

    def cut(key: tuple, part: pa.Table, bits: pa.Table) -> pa.Table:
        texts = as_bytes(part["text"])
        borders, first, place, bucket, hashes = _windows(texts, width, buckets)
        repeated = np.bincount(place, minlength=len(hashes)) > 1
        for b, seen in zip(bits["bucket"].to_pylist(), bits["seen"].to_pylist()):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            repeated[lo:hi] |= np.unpackbits(np.frombuffer(seen, np.uint8), count=hi - lo).astype(bool)
        marks = np.zeros(borders[-1] + 1, np.int32)
        bad = first[repeated[place]] if len(place) else first
        np.add.at(marks, bad, 1)
        np.add.at(marks, bad + width, -1)
        covered = np.cumsum(marks)[:-1] > 0
        n_words, n_removed, removed, kept = [], [], [], []
        for i, text in enumerate(texts):
            mine = covered[borders[i] : borders[i + 1]]
            words = text.split()
            gone = int(mine.sum())
            n_words.append(len(mine))
            n_removed.append(gone)
            removed.append([{"first": a, "last": b} for a, b in _spans(mine)] if gone else [])
            kept.append(b" ".join([w for w, g in zip(words, mine.tolist()) if not g] if gone else words))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table({
            "row": part["row"],
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(removed, span),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    sent = dealt.groupBy("batch").applyInArrow(send, "batch long, bucket int, hashes binary")
    bits = sent.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, seen binary")
    span = T.ArrayType(T.StructType().add("first", T.LongType()).add("last", T.LongType()))
    out = T.StructType().add("row", docs.schema).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("removed", span).add("kept", T.StringType())
    done = dealt.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(cut, out)
    return done.union(short.mapInArrow(_short, out)).select("row.*", *own)


@query(
    "op10_substring_dedup",
    f"""with w as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
starts as (select r, unnest(range(1, len(ws) - {WINDOW} + 2)) as i, ws from w where len(ws) >= {WINDOW}),
wins as (select r, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) as h from starts),
twice as (select h from wins group by h having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + {WINDOW})) as i from wins join twice using (h)),
per as (select r, list(i) as g from gone group by r),
kept as (select doc_id, ws, coalesce(len(g), 0) as n_removed, case when g is null then ws else
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(g, x[2])), lambda x: x[1]) end as k from w left join per using (r))
select doc_id, len(ws)::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
)
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the windows of 35 words that occur more than once."""
    done = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
