"""Exact dedup, token alignment and periodic runs against plain Python versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import WORD
from priorsight.llm import grace_dedup, heavy, periodic_runs, token_alignment

DOCS = "doc_id long, text string, lang string"
CLASHING = ["row", "rows", "content", "hash", "bucket", "parts", "lanes", "lane", "pivot", "keep_id", "group_size", "kept", "n_words", "runs", "collapsed", "n_a", "links", "n", "key", "id"]
SPACE = re.compile(r"[\x20\x09-\x0D]")


def some_texts(rng):
    base = [" ".join(rng.choice(["la", "the", "Ünïcode", "x", "日本語", "🙂", "done."]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts = [None, "", " \t\n", "x", " x", "x  y", "a b", "<|endoftext|> <s> </s> <unk>", "▁low▁line", "tab\there\r\nnew", "nul\0nul", "é ﬁ ① Ⅷ", "<0x41>"]
    texts += base + base[:20] + [t.replace(" ", "\n ") for t in base[:10]] + [base[0]] * 90 + [None] * 40 + ["la " * 3000, "z" * 5000]
    return texts


@pytest.fixture(scope="module")
def given():
    texts = some_texts(random.Random(5))
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, texts[21], "de"), (None, None, None), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame(given, DOCS).withColumns({c: F.lit("mine") for c in CLASHING}).repartition(6).cache()


#: Few large buckets; small ones, parted again, with heavy contents sent to all; and dealt in lanes.
SIZES = ({}, {"heavy": 3000}, {"heavy": 3000, "sent": 0})


@pytest.mark.parametrize("sizes", SIZES)
def test_grace_deduplication(spark, docs, given, sizes):
    got = grace_dedup.deduplicate(docs, bucket=2000 if sizes else grace_dedup.BUCKET, **sizes)
    assert set(got.columns) == set(docs.columns) | {"text_sha256"}
    groups: dict = {}
    for i, t, _ in given:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t, lang in given:
        plain = SPACE.sub("", t or "")
        size, _, best = min(groups[plain], key=lambda x: (x[0], x[1], x[2] or 0))
        want.append((i, t, lang, best, len(groups[plain]), i == best and len(t or "") == -size, hashlib.sha256(plain.encode()).hexdigest()))
    rows = [(r.doc_id, r.text, r.lang, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_grace_recursion_parts_large_buckets(spark):
    # All hashes are multiples of the first number of buckets, so one bucket holds them all until it is parted anew.
    weights = spark.range(3000).select((F.col("id") * (300_000 // 2000 + 1)).alias("hash"), F.lit(1).alias("n"), F.lit(100).alias("weight"))
    sizes = grace_dedup._buckets(weights, 2000)(weights).groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("hashes"))
    hashes, most = sizes.agg(F.sum("hashes"), F.max("weight")).first()
    assert hashes == 3000 and most <= 4000


def test_open_addressing_compares_whole_contents():
    contents = [b"a", b"b", b"a", b"", b"b", b"c"]
    assert grace_dedup._numbered(contents, [7] * 6) == ([0, 1, 0, 2, 1, 3], [0, 1, 3, 5])
    assert grace_dedup._numbered([], []) == ([], [])


def test_heavy_contents_with_one_hash(spark, monkeypatch):
    """Rows of a heavy hash that differ from its pivot are compared with the light ones."""
    monkeypatch.setattr(heavy.F, "xxhash64", lambda *c: F.length(F.col("content")).cast("long") if c == ("content",) else F.hash(*c).cast("long"))
    rows = [(i, ["aa", "bb", "cc", "d"][i % 4], None) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    for sent in (0, 1 << 20):
        got = grace_dedup.deduplicate(df, heavy=2000, sent=sent, bucket=1 << 20).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, i % 4, 20) for i in range(80)]


@pytest.fixture(scope="module")
def models():
    return token_alignment.BytePairs(), token_alignment.WordPieces()


def plain_alignment(text, a, b, bytes_a, bytes_b):
    """Groups of ids that begin and end together, by walking both lists."""
    if not text:
        return None
    ids = a.encode([text])[0], b.encode([text])[0]
    spelled = [[t[i] for i in x] for t, x in zip((bytes_a, bytes_b), ids)]
    if any(b"".join(s) != b" " + text.encode() for s in spelled):
        return None
    groups, at = [], [0, 0]
    while at[0] < len(ids[0]):
        begin, size = list(at), [0, 0]
        while True:
            side = 0 if size[0] <= size[1] else 1
            size[side] += len(spelled[side][at[side]])
            at[side] += 1
            if size[0] == size[1]:
                break
        groups.append((ids[0][begin[0] : at[0]], ids[1][begin[1] : at[1]]))
    return groups


@pytest.mark.parametrize("sizes", SIZES)
def test_alignment(spark, docs, given, models, sizes):
    a, b = models
    tokens = []
    for m in models:
        v = m.vocabulary()
        tokens.append([v.data[p:q].tobytes() for p, q in zip(v.starts, v.starts[1:])])
    groups = [plain_alignment(t, a, b, *tokens) for _, t, _ in given]
    assert sum(g is None for g in groups) > 40 and sum(g is not None for g in groups) > 100
    count, best = {}, {}
    for of in groups:
        for x, y in of or ():
            count[x[-1], y[-1]] = count.get((x[-1], y[-1]), 0) + 1
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for (i, t, lang), of in zip(given, groups):
        if of is None:
            want.append((i, t, lang, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in of]
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in of).encode()).hexdigest()
        want.append((i, t, lang, sum(len(x) for x, _ in of), sum(len(y) for _, y in of), len(of), len(of), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), digest))
    got, pairs = token_alignment.align(docs, a=a, b=b, **sizes)
    rows = [(r.doc_id, r.text, r.lang, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert {((r.a_id, r.b_id), r["count"], r.best) for r in pairs.collect()} == {(k, n, n == best[k[1]]) for k, n in count.items()}


def test_both_libraries_encode_alike(given, models):
    a, _ = models
    texts = [t for _, t, _ in given if t] + ["a" * 399, "b" * 401, " " * 800, "x" + " \n" * 300 + "y", "ab " * 400, "it's we'll 12345 --- \u00a0\u2003 end "]
    plain = [e.ids for e in a.model().encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert a._ranked is not None and a.encode(texts) == plain


def brute_runs(words, length, times):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(length, times * q) and not any(q % d == 0 and all(words[k] == words[k + d] for k in range(s, s + size - d)) for d in range(1, q)):
                found.append((s, size, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_sequences():
    rng = random.Random(1)
    for _ in range(400):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 2, 3, 4, 6])
        words = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 8)
            words = words[:a] + [words[min(a + i % p, n - 1)] for i in range(n - a)]
        symbols = np.array(words)
        for length, times in ((6, 4), (2, 2), (5, 3)):
            want = brute_runs(words, length, times)
            assert list(map(tuple, periodic_runs.runs_of(symbols + 1, length, times).tolist())) == want
            at, stretch = periodic_runs._possible(symbols, np.zeros(n, int), length, times)
            assert [tuple(r) for r in (periodic_runs._placed(symbols[at], at, stretch, length, times) if len(at) else [])] == want


def test_runs_of_documents(spark, docs, given):
    for length, times in ((6, 4), (3, 2)):
        got = periodic_runs.find_runs(docs, length, times)
        assert set(got.columns) == set(docs.columns)
        want = []
        for i, t, lang in given:
            words = WORD.findall(t or "")
            if len(words) > 2000:  # one word again and again
                runs = [(0, len(words), 1)]
            else:
                runs = brute_runs(words, length, times)
            gone = {k for s, n, p in runs for k in range(s + p, s + n)}
            want.append((i, t, lang, len(words), [tuple(r) for r in runs], " ".join(w for k, w in enumerate(words) if k not in gone)))
        rows = [(r.doc_id, r.text, r.lang, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_runs_of_long_texts(spark):
    rng = random.Random(2)
    part = [f"w{rng.randrange(900)}" for _ in range(7000)]
    texts = [" ".join(part * 6), " ".join(f"v{rng.randrange(50)}" for _ in range(60_000)), " ".join(["a"] * 50_000)]
    got = periodic_runs.find_runs(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    assert [(x.start, x.length, x.period) for x in got[0].runs] == [(0, 42_000, 7000)]
    assert got[0].collapsed == " ".join(part) and got[2].collapsed == "a"
    assert [(x.start, x.length, x.period) for x in got[2].runs] == [(0, 50_000, 1)]
    assert all(x.length >= max(6, 4 * x.period) for x in got[1].runs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert grace_dedup.deduplicate(none).count() == 0
    assert periodic_runs.find_runs(none).count() == 0
    rows, pairs = token_alignment.align(none)
    assert rows.count() == 0 and pairs.count() == 0
