"""Every stage of the pipeline on the smallest tables, each against a plain version on its own input."""

from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from brute import WORD, lowered, near_components
from priorsight.llm import quality, sentence_pieces
from priorsight.plans.lineage import checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("pipeline")
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = (before, docs.collect())
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "sentence_pieces"]
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(after[0].asDict()) == columns for name, (_, after) in stages.items() if name != "sentence_pieces")


def test_quality(spark, stages):
    before, after = stages["quality"]
    stayed = {r.doc_id for r in after}
    model = quality.fit_labelled(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), model)
    assert stayed == {r.doc_id for r in scored.collect() if r.quality_score >= quality.THRESHOLD}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in stayed) == bool(m) for i, m in marks.items() if i in {r.doc_id for r in before}]
    assert sum(right) >= 0.95 * len(right)


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    want, sizes = near_components({r.doc_id: lowered(r.text) for r in before}, 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in want.items() if i == c or not sizes[i])


def test_substrings(stages):
    before, after = stages["substring_dedup"]
    counts: dict = {}
    for r in before:
        w = WORD.findall(r.text)
        for i in range(len(w) - 34):
            counts[tuple(w[i : i + 35])] = counts.get(tuple(w[i : i + 35]), 0) + 1
    got = {r.doc_id: r for r in after}
    for r in before:
        w = WORD.findall(r.text)
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert got[r.doc_id].text == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text)
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_mixing(stages):
    before, after = stages["mixing"]
    size: dict = {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size))}
    full: set = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / share for s in size}
        if not (more := {s for s in size if s not in full and target[s] > 3 * size[s]}):
            break
        full |= more
    taken = dict.fromkeys(size, 0)
    whole = {r.doc_id: r.text for r in before}
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
        assert r.text == whole[r.doc_id] or r.text.split(" ") == WORD.findall(whole[r.doc_id])[: len(r.text.split(" "))]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_pieces(stages):
    before, after = stages["sentence_pieces"]
    assert sorted((r.doc_id, r.text) for r in before) == sorted((r.doc_id, r.text) for r in after)
    model = sentence_pieces.Pieces.load()
    for r in after:
        raw = b"".join(model.data[model.starts[i] : model.starts[i + 1]].tobytes() for i in r.ids)
        assert raw[1:].decode() == r.text


def test_run(spark, stages):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    known = set(folder.glob("pipeline-*"))
    assert pipeline.run(spark, SF).count() == len(stages["sentence_pieces"][1])
    (made,) = set(folder.glob("pipeline-*")) - known
    assert [p.name for p in made.iterdir() if p.is_dir()] == ["mixing"]  # what the result is read from; the others are gone


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, blanks, a very long text, repeated rows, copies and columns with the stages' own names: each stage's stated result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()
    good = max((r for r in docs), key=lambda r: len(WORD.findall(r.text))).text
    rows = [tuple(r) for r in docs]
    long = " ".join(f"{r.text} part{i}" for i, r in enumerate(docs) for _ in range(3))
    rows += [(9_001, None, "en", "web", 0), (9_002, "", None, None, None), (9_002, "", None, None, None), (9_003, " \n\t ", "en", "web", 4), (None, good, None, None, None), (None, good, None, None, None),
             (9_004, good, "en", None, len(good)), (9_005, long, "en", "web", len(long)), (None, None, None, None, None), (None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long".split(", ")
    extra = ["doc", "row", "kept", "number", "quality_score", "n_removed", "taken", "position", "reading", "_reading", "cls", "in_doc"]
    schema = ", ".join(names + [f"`{e}` int" for e in extra])
    docs = spark.createDataFrame([r + tuple(range(len(extra))) for r in rows], schema).repartition(4)
    columns, out = docs.columns, {}
    for name, stage in pipeline.STAGES:
        assert sorted(stage(spark, docs.limit(0), SF).collect()) == []
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = docs if name == "quality" else spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(columns)] == columns and all(tuple(r)[5 : 5 + len(extra)] == tuple(range(len(extra))) for r in out[name][1])
    texts = {name: [(r.doc_id, r.text) for r in after] for name, (_, after) in out.items()}
    # Rows judged alike stay alike, however often they stand there.
    assert all(texts["quality"].count(x) in (0, rows.count(r)) for r in rows for x in [(r[0], r[1])])
    # Of repeated rows and copies one stays; rows without words are linked with nothing, so all of them stay.
    assert sum(t == good for _, t in texts["near_dedup"]) == 1
    blanks = [(9_001, None), (9_002, ""), (9_002, ""), (9_003, " \n\t "), (None, None), (None, None)]
    assert sorted(map(str, (x for x in texts["near_dedup"] if not (x[1] or "").strip()))) == sorted(map(str, blanks))
    # Cutting keeps every row, and texts without a repeated window as they were.
    assert len(texts["substring_dedup"]) == len(texts["near_dedup"]) and set(blanks) <= set(texts["substring_dedup"])
    # The mix reads no text without words; whatever it reads is encoded, and decodes to its text.
    assert all(t and t.strip() for _, t in texts["mixing"]) and len(texts["sentence_pieces"]) == len(texts["mixing"])
    model = sentence_pieces.Pieces.load()
    for r in out["sentence_pieces"][1]:
        assert b"".join(model.data[model.starts[i] : model.starts[i + 1]].tobytes() for i in r.ids)[1:].decode() == r.text
