"""The operators of the training-data subpackage on hand-made cases, against plain Python versions."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import WORD, lowered, near_components
from priorsight.llm import language_id, license_scan, mixing, near_dedup, nearest_blocks, pivot_search, quality, sentence_pieces, substring_dedup, url_filters, vector_blocks
from priorsight.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; an input with such columns must not confuse them.
CLASHING = ["row", "text_key", "block", "batch", "size", "n_words", "kept", "ids", "draw", "position", "quality_score", "lang_pred", "rank", "turn", "word", "n", "key", "of_doc", "alone", "due"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=3):
    """Ids, texts and sources with nulls, blanks, copies, near copies, shared passages, one long text, repeated rows and a hot source."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(40, 160)) for _ in range(40)]
    passage = words(rng, 50)
    texts = [None, "", " \n\t ", "one", "one two three", "one two three"] + base + base[:10]
    texts += [t + " extra" for t in base[:15]] + [b[: len(b) // 2] + " " + passage + " " + b[len(b) // 2 :] for b in base[20:30]]
    texts += [words(rng, 30_000, 5_000), base[1].upper()] + [base[0] + f" tail{i}" for i in range(60)]
    out = [(i, t, "en" if i % 3 else None, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[8], out[8], (None, base[5], "de", "s1", 7), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit("x") for c in CLASHING}).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_near_duplicates(docs, none):
    given = rows()
    for n_words, percent in ((4, 80), (5, 80), (4, 60)):
        got = near_dedup.near_duplicates(docs, n_words, percent).collect()
        assert len(got) == len(given)
        want, sizes = near_components({i: lowered(r[1]) for i, r in enumerate(given)}, n_words, percent)
        ids = {i: r[0] for i, r in enumerate(given)}
        groups: dict = {}
        for i, c in want.items():
            groups.setdefault(c, []).append(ids[i])
        least = {c: min((x for x in v if x is not None), default=None) for c, v in groups.items()}
        named = sorted(((ids[i], sizes[i], least[c] if sizes[i] else ids[i]) for i, c in want.items()), key=repr)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == named
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(none).count() == 0


def test_one_of_each(docs):
    stay = near_dedup.one_of_each(docs, 4).collect()
    want, sizes = near_components({i: lowered(r[1]) for i, r in enumerate(rows())}, 4, 80)
    assert len(stay) == len({c for i, c in want.items() if sizes[i]}) + sum(not n for n in sizes.values())
    assert set(stay[0].asDict()) == set(docs.columns)


def test_large_groups_of_near_copies(spark):
    """More near copies than a node holds, in one component, none lost."""
    rng = random.Random(5)
    base = words(rng, 120, 5000).split()
    texts = []
    for i in range(500):
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        texts.append((i, " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 4).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 500


def test_large_groups_of_loosely_near_copies(spark):
    """More copies than a node holds, with similarities to their origin from 0.6 to 1: every link counts, whatever block its ends are in."""
    rng = random.Random(11)
    base = words(rng, 250, 5000).split()
    texts = {}
    for i in range(400):
        t = list(base)
        for at in rng.sample(range(len(t)), rng.randrange(0, 16)):
            t[at] = f"x{i}y{at}"
        texts[i] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4).collect()}
    want, _ = near_components(texts, 4, 80)
    assert len(set(want.values())) > 20
    assert got == want


@pytest.mark.parametrize("percent", [50, 60, 80, 90])
def test_trees_reach_the_recall(percent):
    """Pairs at the threshold, followed through trees that branch at every level."""
    rng, misses, trees = random.Random(7), 0, near_dedup.trees_for(percent)
    whole, part = divmod(100, percent)

    def meets(level):
        if rng.random() * 100 >= percent:
            return False
        return level == near_dedup.LEVELS or any([meets(level + 1) for _ in range(whole + (rng.random() * percent < part))])

    for _ in range(4000):
        misses += not any(meets(1) for _ in range(trees))
    assert misses / 4000 <= 1.6 * (1 - near_dedup.RECALL)
    assert near_dedup.trees_for(80) == 10


def test_substrings(docs, none):
    given = rows()
    width = 12
    counts: dict = {}
    for r in given:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - width + 1):
            counts[tuple(w[i : i + width])] = counts.get(tuple(w[i : i + width]), 0) + 1
    want = []
    for r in given:
        w = WORD.findall(r[1] or "")
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    done = substring_dedup.remove_repeats(docs, width)
    assert set(docs.columns) <= set(done.columns)
    got = done.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(want, key=repr)
    assert all(sum(s["last"] - s["first"] for s in r.removed) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_equal_texts_share_no_batch(spark, monkeypatch):
    """Texts without a window skip the batches, and equal longer ones are dealt by the caller's columns."""
    monkeypatch.setattr(substring_dedup, "BATCH", 1 << 10)
    text = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \v\f a\r\nb ", " ".join(["c"] * 34) + " ", text] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select(F.struct("i").alias("doc"), "text")
    dealt = []
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (dealt.append(self), group(self, *c))[1])
    got = substring_dedup.remove_repeats(df, spread=[F.col("doc.i")]).collect()
    batches = {r.batch: r["count"] for r in group(next(d for d in dealt if "batch" in d.columns), "batch").count().collect()}
    assert sum(batches.values()) == 50 and max(batches.values()) < 50
    assert len(got) == 250
    for r in got:
        words_in = (texts[r.doc.i] or "").split()
        gone = len(words_in) if len(words_in) >= 35 else 0
        assert (r.n_words, r.n_removed, r.kept) == (len(words_in), gone, "" if gone else " ".join(words_in))


def test_mixing(docs, none):
    given = rows()
    got = mixing.mix(docs).collect()
    assert len(got) == len(given)
    by: dict = {}
    for r in given:
        by[r[3]] = by.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, full = {}, set()
    while True:
        left = sum(by.values()) - sum(3 * by[s] for s in full)
        target = {s: 3 * by[s] if s in full else left * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in by}
        more = {s for s in by if s not in full and target[s] > 3 * by[s]}
        if not more:
            break
        full |= more
    taken: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source_size, round(r.target, 6)] = taken.get((r.source_size, round(r.target, 6)), 0) + r.taken
    want: dict = {}
    for s in by:
        k = (by[s], round(target[s], 6))
        want[k] = want.get(k, 0) + round(target[s])
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}
    mixed = mixing.mixed_documents(docs).collect()
    assert set(mixed[0].asDict()) == set(docs.columns)
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed) - sum(taken.values())) <= 200  # of repeated rows one stands for both
    assert mixing.mix(none).count() == 0


def test_schedule_inverse(spark):
    knots = ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5))
    shares = [i / 20 for i in range(21)]
    found = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(F.expr(mixing.inverse_schedule("s", knots))).collect()]
    fine = np.linspace(0, 1, 200_001)
    area = np.cumsum(np.interp(fine, [0, 0.5, 1], [1, 1.5, 0.5]))
    for s, t in zip(shares, found):
        assert abs(np.interp(t, fine, area / area[-1]) - s) < 1e-4


def test_vectors(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(rng.normal(size=(300, 12))))]
    data += [(i, data[7][1]) for i in range(300, 340)]  # one very common vector
    bad = [(400, None), (420, []), (440, [0.0] * 12), (460, [float("nan")] + [0.0] * 11), (480, [None] + [1.0] * 11), (None, data[0][1]), (500, [1.0, 2.0]), (520, [3.0, 1.0]), (20, data[20][1])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).repartition(4)
    good = dict(data) | {500: [1.0, 2.0], 520: [3.0, 1.0]}

    def brute(score, every, k, extra=()):
        out = {}
        vectors = good | dict(extra)
        for q, v in vectors.items():
            if q % every == 0:
                found = sorted((-score(v, w), c) for c, w in vectors.items() if c != q and len(v) == len(w))[:k]
                out[q] = [(c, -s) for s, c in found]
        return out

    got: dict = {}
    for r in nearest_blocks.neighbours(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(lambda v, w: sum(float(a) * float(b) for a, b in zip(v, w)), 20, 20)
    assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items() if v}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q]))

    got = {}
    for r in pivot_search.top_products(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(lambda v, w: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), 50, 5, [(440, [0.0] * 12)])
    assert got == {q: v for q, v in want.items() if v}
    empty = spark.createDataFrame([], df.schema)
    assert nearest_blocks.neighbours(empty, empty).count() == 0 and pivot_search.top_products(empty, empty).count() == 0


def test_searches_over_many_blocks(spark, monkeypatch):
    rng = random.Random(23)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    data += [(i, data[7][1]) for i in range(300, 400)]  # a vector that a quarter of all rows hold
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = {}
    for search, every in ((nearest_blocks.neighbours, 20), (pivot_search.top_products, 50)):
        for components in (1 << 23, 6 * 40):  # all in one block, and forty rows a block
            monkeypatch.setattr(vector_blocks, "COMPONENTS", components)
            got = sorted(tuple(r) for r in search(df, df.filter(f"vec_id % {every} = 0")).collect())
            assert want.setdefault(search, got) == got and {r[0] for r in got} == set(range(0, 400, every))
    sides = nearest_blocks.packed_blocks(df, 8_192, nearest_blocks.quantised, nearest_blocks.FIELDS)
    assert sides.count() == 10


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1e9, 3.0]), (50, [-1e9, 1.0]), (51, [2.5, 1e8]), (52, [1e30, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in pivot_search.top_products(df, df.filter("vec_id = 0")).collect()}
    assert got[0, 51] == 256_000_000_000 * 640 + 768 * 25_600_000_000
    assert got[0, 52] == 2**63 - 1 and got[0, 50] == -(2**63)


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x", "http://example.net/de", "http://net/", "http://net", "ftp://x.org/fr/#a", "no scheme", None, "", "http://", "http://notnet/en/",
            "http://spam-farm.example.org/en/", "http://x.com/ads/y", "http://x.example.com/de/?q", "x://y.org/fr/a\nb"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string").withColumn("rank", F.lit(2))
    got = {}
    for r in url_filters.filter_urls(df, url_filters.SITE_RULES + url_filters.PATTERN_RULES).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.matched, r.verdict))
    assert len(got[0]) == 2 and len(got[None]) == 1
    assert got[0][0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][0] == ("example.net", "/de", "net/", "block")
    assert [got[i][0][2:] for i in (2, 3, 4)] == [("net/", "block"), (None, "allow"), ("org/fr/", "allow")]
    assert [got[i][0] for i in (5, 6, 7, 8)] == [("", "", None, "allow")] * 4
    assert [got[i][0][2:] for i in (9, 10, 11, 12, 13)] == [(None, "allow"), ("spam-farm.", "block"), ("/ads/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert {r.verdict for r in url_filters.filter_urls(df, []).collect()} == {"allow"}


def test_licenses(spark, none):
    notice = license_scan.TEMPLATES["gpl-notice"].split()
    texts = [None, "", "x", "Released under the MIT License.", "a CC-BY, b\n\nCC by", " ".join(notice[:20]) + "\n" + " ".join(notice[20:-3]), "agnu general public license",
             "gnu\ngeneral\tpublic   LICENSE é gnu general public license", "filler " * 50_000 + "apache license"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "mit license")], "doc_id long, text string").withColumn("row", F.lit(1))
    got: dict = {}
    for r in license_scan.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, [m["template"] for m in r.met]))
    assert got[0][0] == got[1][0] == (0, 0, None, None, [], [])
    assert got[3] == [(5, 1, 3, 3, ["mit"], ["mit-line"])] * 2
    assert got[4][0] == (6, 2, 1, 4, ["cc-by"], [])
    assert "gpl-notice" in got[5][0][5] and got[6][0][1] == 0
    assert got[7][0][:5] == (9, 2, 0, 5, ["gpl"]) and got[8][0][:4] == (50_002, 1, 50_000, 50_000)
    assert got[None][0][4] == ["mit"]
    assert license_scan.scan_licenses(none).count() == 0


def test_licenses_inside_long_blocks(spark):
    """A notice anywhere in a long line or paragraph is found; results equal a search of all blocks and windows by loops."""
    rng = random.Random(8)
    mit, bsd = license_scan.TEMPLATES["mit-notice"], license_scan.TEMPLATES["bsd-notice"]
    texts = [f"{words(rng, 300)} {mit} {words(rng, 300)}", "one two three four five six seven eight nine ten eleven All rights reserved", words(rng, 5_000)]
    texts += [f"{words(rng, before)} {bsd}\n{words(rng, 200)}" for before in range(95, 160, 7)]
    texts += [" ".join(rng.choice(mit.split() + ["filler"] * 20) for _ in range(2_000)), (mit + " ") * 40, " ".join(w for w in mit.split() if rng.random() < 0.85) + " " + words(rng, 400)]
    plan, sets = license_scan.window_plan(license_scan.TEMPLATES), license_scan.template_sets(license_scan.TEMPLATES)

    def plainly(text):
        best: dict = {}
        for paragraph in text.split("\n\n"):
            for name, (size, step, need) in plan.items():
                found = license_scan.words_of(paragraph)
                blocks = [set(license_scan.words_of(b)) for b in [paragraph, *paragraph.split("\n")]]
                blocks = [b for b in blocks if len(b) <= license_scan.SPREAD * len(sets[name])]
                blocks += [set(found[i : i + size]) for i in range(0, len(found) - size + step, step)] if len(found) > size else []
                shared = max((len(b & set(sets[name])) for b in blocks), default=0)
                if shared >= need:
                    best[name] = max(best.get(name, 0), shared / len(sets[name]))
        return best

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {m["template"]: m["containment"] for m in r.met} for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: plainly(t) for i, t in enumerate(texts)}
    assert got[0] == {"mit-notice": 1.0} and "reserved" in got[1] and not got[2] and all("bsd-notice" in got[i] for i in range(3, 13))


def test_places_that_overlap(spark):
    df = spark.createDataFrame([(1, "x x x"), (2, "xx x")], "doc_id long, text string")
    assert [r.n_base for r in license_scan.scan_licenses(df, {"x x": "x"}, {}).orderBy("doc_id").collect()] == [2, 0]


def test_pieces(docs, none):
    model = sentence_pieces.Pieces.load()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    for dropout in (0.0, 0.3):
        done = sentence_pieces.decode(sentence_pieces.encode(docs, model, dropout=dropout), model).collect()
        assert len(done) == docs.count()
        assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in done)
        same = [r.ids == library.encode(r.text) for r in done if r.text]
        assert all(same) if dropout == 0 else not any(s for s, r in zip(same, [r for r in done if r.text]) if len(r.text) > 100)
    odd = docs.sparkSession.createDataFrame([(1, "a▁b  é\n\n 日本 \U0001d518 " + "ab" * 100)], "doc_id long, text string")
    one, other = (sentence_pieces.encode(odd, model, seed=s, dropout=0.5) for s in (1, 2))
    assert sentence_pieces.decode(one, model).first().decoded == odd.first().text
    assert one.first().ids == one.first().ids != other.first().ids
    assert sentence_pieces.encode(none, model).count() == 0


def test_heap_and_matrix_agree():
    model = sentence_pieces.Pieces.load()
    rng = random.Random(4)
    chunks = [" " + "".join(rng.choice("abcdehinorstuéß") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    variants = np.arange(200) % 5
    ids, counts = model.segment(chunks, variants, 9, 0.2)
    long, sentence_pieces.LONG = sentence_pieces.LONG, 0
    try:
        heap_ids, heap_counts = model.segment(chunks, variants, 9, 0.2)
    finally:
        sentence_pieces.LONG = long
    assert ids.tolist() == heap_ids.tolist() and counts.tolist() == heap_counts.tolist()


def test_quality(spark, none):
    rng = random.Random(8)
    good = [words(rng, rng.randrange(20, 200), 3000).replace(" ", ". ", 3) for _ in range(150)]
    bad = ["### " + words(rng, 3) + " $$$ " * rng.randrange(10, 60) for _ in range(80)]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, good[0])], "doc_id long, text string").withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(230)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_labelled(documents, labels)
    assert model.rules and model.described()
    got = {r.doc_id: r.quality_score for r in quality.score(documents, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 233
    out = [i for i in range(230) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i < 150) for i in out) >= 0.95 * len(out)
    assert quality.score(none, model).count() == 0
    same = quality.fit_labelled(documents, labels.filter("quality = 1"))
    assert not same.rules and quality.fit_labelled(documents, labels.limit(0)).intercept == 0


def test_languages(spark, none):
    rng = random.Random(6)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(rng.randrange(5, 80)))
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["für", "ung", "sch", "ein"]}
    data = [(i, make(parts[k]), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(data + [(500, None, "aa"), (501, "123 !!", None), (502, "", None), (None, make(parts["aa"]), None)], "doc_id long, text string, lang string").withColumn("row", F.lit(1))
    net = language_id.learn(df.filter(~language_id.held_out()), steps=150)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify(df, net).collect()}
    assert [got[i] for i in (500, 501, 502)] == [("und", 0.0)] * 3
    out = [(i, k) for i, _, k in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i][0] == k for i, k in out) >= 0.95 * len(out) and got[None][0] in parts
    assert language_id.learn(df.filter("lang is null")) is None
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.identify(none, net).count() == 0


def test_hash_of_kept(spark):
    """The digest column is that of the kept words."""
    text = "a  b\tc"
    kept = substring_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.sha2("kept", 256)).first()[0]
    assert kept == hashlib.sha256(b"a b c").hexdigest()


def plain_agenda(model, chunk, key, dropout):
    """The best-scored merge first, the leftmost among equals, each skipped by its own draw; by a list that is searched anew each time."""
    parts = [(i, i + 1, model.chars.get(c)) for i, c in enumerate(chunk)]
    gone = set()
    while True:
        offers = []
        for left, right in zip(parts, parts[1:]):
            made = None if left[2] is None or right[2] is None else model.table.get(left[2] << 15 | right[2])
            if made and (left[0], right[1]) not in gone:
                offers.append((made[0], left[0], right[1], made[1]))
        if not offers:
            break
        _, first, last, piece = min(offers)
        if sentence_pieces._draw(key, first, last) < dropout * (2**64 - 1):
            gone.add((first, last))
        else:
            parts = [p for p in parts if not (first <= p[0] and p[1] <= last)] + [(first, last, piece)]
            parts.sort()
    return [i for a, _, p in parts for i in ([p] if p is not None else [model.first_byte + b for b in chunk[a].encode()])]


def test_every_occurrence_draws_for_itself():
    model = sentence_pieces.Pieces.load()
    rng = random.Random(12)
    chunks = [" information", " the", "a", "\n", " \U0001d518x", " " + "ab" * 40, ""[:0] + "   "] + [" " + "".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    of = np.array([0] * 2_000 + [rng.randrange(len(chunks)) for _ in range(3_000)])
    keys = np.array([rng.getrandbits(64) for _ in of], np.uint64)
    for dropout in (0.0, 0.1, 0.6, 1.0):
        ids, counts, leaf = model.segment_each(chunks, of, keys, dropout)
        ends = np.cumsum(counts)
        got = [ids[ends[e] - counts[e] : ends[e]].tolist() for e in leaf.tolist()]
        some = [*range(150), *range(2_000, 3_000)]
        assert [got[o] for o in some] == [plain_agenda(model, chunks[of[o]], int(keys[o]), dropout) for o in some]
        if dropout == 0.6:
            assert len({tuple(g) for g in got[:2_000]}) > 16
    assert len(model.segment_each([], np.empty(0, np.int64), np.empty(0, np.uint64), 0.1)[2]) == 0


def test_readings_draw_anew(spark):
    model = sentence_pieces.Pieces.load()
    text = "international information about segmentation " * 30
    df = spark.createDataFrame([(1, text, 0), (1, text, 1), (1, text, 1)], "doc_id long, text string, reading int")
    ids = [r.ids for r in sentence_pieces.encode(df, model, reading=F.col("reading")).orderBy("reading").collect()]
    assert ids[0] != ids[1] == ids[2]
    assert all(r.decoded == text for r in sentence_pieces.decode(sentence_pieces.encode(df, model, reading=F.col("reading")), model).collect())


def test_a_long_word_takes_little_time():
    model = sentence_pieces.Pieces.load()
    started = time.time()
    model.agenda(" " + "information" * 30_000, 5, 0.1)
    assert time.time() - started < 60


def test_languages_learned_are_bounded(spark):
    """A column with a value of its own for most documents: the common languages are learned, the smaller name first among equals."""
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcde" if i % 2 else "vwxyz") for _ in range(200)), "aa" if i % 2 else "vv") for i in range(120)]
    df = spark.createDataFrame(texts + [(1_000 + i, "mixed words", f"only{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    assert sorted(language_id.learn(df, steps=20, languages=3).languages) == ["aa", "only000", "vv"]
    net = language_id.learn(df, steps=150, languages=2)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, net).collect()}
    assert all(got[i] == lang for i, _, lang in texts) and set(got.values()) == {"aa", "vv"}


def plain_network(net, text):
    """Language and probability by filters, pooling and softmax written out by loops, over all windows of a text."""
    data = text.encode()
    windows = [data[i : i + 256] for i in range(0, len(data), 256)]
    embedding, bias, weights, offset = net.embedding.tolist(), net.bias.tolist(), net.weights.tolist(), net.offset.tolist()
    sums = [0.0] * len(net.languages)
    for window in windows:
        x = window + bytes(256 - len(window))
        pooled = []
        for f in net.filters:
            f = f.tolist()
            made = [[{b: sum(e * row[k] for e, row in zip(embedding[b], part)) for b in set(x)} for part in f] for k in range(len(f[0][0]))]
            pooled += [max(sum(m[j][x[i + j]] for j in range(len(f))) for i in range(256 - len(f) + 1)) for m in made]
        hidden = [max(p + b, 0.0) for p, b in zip(pooled, bias)]
        logits = [sum(h * w[k] for h, w in zip(hidden, weights)) + offset[k] for k in range(len(sums))]
        log_sum = math.log(sum(math.exp(v - max(logits)) for v in logits)) + max(logits)
        sums = [s + len(window) * (v - log_sum) for s, v in zip(sums, logits)]
    means = [math.exp(s / len(data)) for s in sums]
    best = max(range(len(means)), key=means.__getitem__)
    return net.languages[best], means[best] / sum(means)


def test_windows_against_loops(spark):
    """Long texts, repeated rows and bytes beyond ASCII among them."""
    rng = random.Random(9)
    letters = {"aa": "abcde ", "vv": "vwxyz ", "ru": "абвгд "}
    texts = [(i, "".join(rng.choice(letters[lang] + "no") for _ in range(rng.choice([5, 200, 256, 700]))) + "n", lang) for i, lang in enumerate(["aa", "vv", "ru"] * 12)]
    df = spark.createDataFrame(texts + texts[:5], "doc_id long, text string, lang string")
    net = language_id.learn(df, steps=40)
    got = language_id.identify(df, net).collect()
    assert len(got) == len(texts) + 5
    want = {i: plain_network(net, text) for i, text, _ in texts}
    assert all(r.lang_pred == want[r.doc_id][0] and abs(r.lang_score - want[r.doc_id][1]) < 1e-4 for r in got)
