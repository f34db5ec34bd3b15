"""Periodic runs: stretches of words that repeat with one period, from suffix trees of a document and of its reversal.

Every maximal repetition has a root that is the longest Lyndon word at its place, under the order of the words or under its
reverse.  So each place gives two candidates, the stretches up to the next smaller and to the next greater suffix, and each
is extended to both sides by its longest common extensions, which the trees answer in constant time.

Before the trees are built, words that cannot be in a run are condensed: a run repeats each of its words ``times`` times, so a
word that is rarer between two such words is in none, nor can a run be extended by it.  A stretch of them becomes one symbol
that occurs nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.llm.registry import query, table
from priorsight.llm.suffix_tree import Extensions
from priorsight.llm.wordhash import pieces

LENGTH, TIMES = 6, 4
#: Rounds of condensing; more would only make the trees smaller.
ROUNDS = 4
_RESULT = ("n_words", "runs", "collapsed")
Prepare = Callable[[object, list[bytes]], list[bytes]]


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _possible(words: np.ndarray, owner: np.ndarray, length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be in a run, and the number of the stretch each is in; ``owner`` is the document."""
    at, stretch = np.arange(len(words)), owner
    for _ in range(ROUNDS):
        if not len(at):
            break
        before = len(at)
        _, back, counts = np.unique(stretch * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        stays = counts[back] >= times
        at, stretch = at[stays], stretch[stays]
        # A stretch ends where a place is missing or the document changes.
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(stretch) > 0)
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= max(length, times)
        at, stretch = at[long], number[long]
        if len(at) == before:
            break
    return at, stretch


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the end."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, length: int = LENGTH, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``length`` symbols and ``times`` periods, by start and period.

    ``symbols`` are whole numbers from 1 on.  The period of a run is its smallest, and no neighbouring symbol extends it.
    """
    n = len(symbols)
    onward = Extensions(symbols)
    rank = onward.rank.tolist()
    smaller, greater = _next_smaller(rank), _next_smaller([-r for r in rank])
    first = np.concatenate((np.arange(n), np.arange(n)))
    root = np.concatenate((smaller[:n], greater[:n]))
    # The empty suffix, at n, is less than all others: a root that ends there has nothing after it to repeat in.
    some = root < n
    first, root = first[some], root[some]
    after = onward.common(first, root)
    period = root - first
    # From the first of a run's roots on, all but less than one period of the run is still to come.
    some = after >= (times - 2) * period
    first, root, after, period = first[some], root[some], after[some], period[some]
    if not len(first):
        return np.empty((0, 3), np.int64)
    before = Extensions(symbols[::-1]).common(n - first, n - root)
    start, size = first - before, before + period + after
    some = size >= np.maximum(length, times * period)
    found = np.unique(np.stack((start[some], period[some], size[some]), axis=1), axis=0)
    return found[:, [0, 2, 1]]


def _searched(length: int, times: int, prepare: Prepare | None):
    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text", 1 << 20):
                words = [t.split() for t in texts]
                if prepare:
                    words = [prepare(k, w) for k, w in zip(part["key"].to_pylist(), words)]
                known = _Numbers()
                numbers = np.fromiter((known[w] for ws in words for w in ws), np.int64)
                counts = np.array([len(ws) for ws in words], np.int64)
                ends = np.cumsum(counts)
                at, stretch = _possible(numbers, np.repeat(np.arange(len(words)), counts), length, times)
                borders = np.searchsorted(at, np.concatenate(([0], ends)))
                found, collapsed = [], []
                for i, ws in enumerate(words):
                    places, of = at[borders[i] : borders[i + 1]], stretch[borders[i] : borders[i + 1]]
                    rows = _placed(numbers[places], places - (ends[i] - counts[i]), of, length, times) if len(places) else []
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in rows])
                    if rows:
                        marks = np.zeros(len(ws) + 1, np.int64)
                        np.add.at(marks, [s + p for s, _, p in rows], 1)
                        np.add.at(marks, [s + n for s, n, _ in rows], -1)
                        ws = [w for w, gone in zip(ws, (np.cumsum(marks) > 0).tolist()) if not gone]
                    collapsed.append(b" ".join(ws))
                yield pa.record_batch({
                    "row": part["row"],
                    "n_words": pa.array(counts),
                    "runs": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
                })

    return run


def _placed(numbers: np.ndarray, places: np.ndarray, stretch: np.ndarray, length: int, times: int) -> list[list[int]]:
    """The runs of one document from the words that may be in runs, in word numbers of the document."""
    names, symbols = np.unique(numbers, return_inverse=True)
    # One symbol of its own stands between two stretches.
    cuts = np.flatnonzero(np.diff(stretch)) + 1
    symbols = np.insert(symbols + 1, cuts, len(names) + 1 + np.arange(len(cuts)))
    places = np.insert(places, cuts, -1)
    rows = runs_of(symbols, length, times)
    rows[:, 0] = places[rows[:, 0]]
    return rows.tolist()


def find_runs(docs: DataFrame, length: int = LENGTH, times: int = TIMES, key: Column | None = None, prepare: Prepare | None = None) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    A run is a stretch of at least ``length`` words and ``times`` periods (2 or more) of its smallest period that no neighbouring
    word extends; runs are listed by start, then period, and may overlap.  ``collapsed`` is the text without the words of any
    run after its first period, joined by single spaces.  ``prepare`` gets ``key`` and the words and returns the words to search.

    Null and blank texts have no words, no runs and an empty ``collapsed``.  Each row is searched by itself, whole, so repeated rows
    repeat their runs; a text of a million repeating words takes about half a minute and a GB.  An empty table gives no rows.
    Columns of the three names are replaced.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.drop(*_RESULT)
    fed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", (F.lit(None).cast("long") if key is None else key).alias("key"))
    span = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    out = T.StructType([T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("runs", span), T.StructField("collapsed", T.StringType())])
    return fed.mapInArrow(_searched(length, times, prepare), out).select("row.*", *_RESULT)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, from one place on periodic in a tenth of all documents; none without an id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


#: crc32 of the decimal doc_id bit by bit; pairs of equal words at one distance, their islands, those without a smaller period.
_SQL = f"""with ids as (select distinct doc_id, cast(doc_id as varchar) as s from documents),
crcs as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::bigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda b, i: case when b % 2 = 1 then xor(b >> 1, 3988292384) else b >> 1 end)), 4294967295) as h from ids),
t as (select doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents join crcs using (doc_id)),
m as (select doc_id, ws, len(ws) as n, g % greatest(len(ws), 1) as a, g, h % 10 = 0 and len(ws) > 0 as made from t),
d as (select doc_id, n, case when not made then ws else list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as ws from m),
w as (select doc_id, n, unnest(ws) as word, unnest(range(n)) as i from d),
pairs as (select x.doc_id, y.i - x.i as q, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and {TIMES} * (y.i - x.i) <= x.n),
islands as (select doc_id, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pairs) group by doc_id, q, k),
long as (select * from islands where l >= greatest({LENGTH}, {TIMES} * q)),
runs as (select * from long r where not exists (select 1 from long o where o.doc_id = r.doc_id and o.q < r.q and r.q % o.q = 0 and o.s <= r.s and o.s + o.l >= r.s + r.l)),
ranked as (select *, row_number() over (partition by doc_id order by l::double / q desc, s, q) as k from runs),
lines as (select doc_id, count(*) as c, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as t from runs group by doc_id),
gone as (select doc_id, list(distinct i) as g from (select doc_id, unnest(range(s + q, s + l)) as i from runs) group by doc_id),
kept as (select doc_id, case when g is null then ws else list_transform(list_filter(list_zip(ws, range(n)), lambda x: not list_contains(g, x[2])), lambda x: x[1]) end as k from d left join gone using (doc_id))
select d.doc_id, coalesce(c, 0)::bigint as n_runs, r.s::bigint as start, r.l::bigint as length, r.q::bigint as period, (1000 * r.l // r.q)::bigint as exponent_milli,
    sha256(coalesce(lines.t, '')) as runs_sha256, sha256(array_to_string(kept.k, ' ')) as collapsed_sha256
from d join kept using (doc_id) left join lines using (doc_id) left join ranked r on r.doc_id = d.doc_id and r.k = 1"""


@query("op13_periodic_runs", _SQL)
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of every document after a tenth of them has been made periodic."""
    done = find_runs(table(spark, sf, "documents").select("doc_id", "text"), key=F.col("doc_id"), prepare=planted)
    first = F.get("runs", F.lit(0))
    best = F.reduce("runs", first, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return done.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
