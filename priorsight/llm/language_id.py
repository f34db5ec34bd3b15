"""Language ID: a byte convolutional network, trained in numpy and applied to windows of whole texts.

Bytes are embedded, filters of several widths slide over a window, each filter keeps its largest response, and
a softmax over these names the language.  A filter's response is a sum of table look-ups, one table per byte of its
width, so neither training nor scoring builds one-hot matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import pieces

#: Bytes in a window.
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
#: Documents to learn from, about, of each language; and passages of each, of so many characters.
SAMPLE, PASSAGES, PASSAGE = 600, 4, 300
#: Languages learned, those with most documents.
LANGUAGES = 100
STEPS, BATCH, RATE = 700, 64, 0.01
UNKNOWN = "und"


@dataclass(frozen=True)
class ByteNetwork:
    languages: tuple[str, ...]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: tuple[np.ndarray, ...]  # per width: width x EMBEDDING x FILTERS
    bias: np.ndarray  # all filters
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray  # languages

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(passages: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 5) -> ByteNetwork:
    """Adam on random crops of the passages, 16 to WINDOW bytes, every language equally often."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    of = [[p for p, x in zip(passages, labels) if x == name and p] or [b" "] for name in languages]
    n_filters = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.3, (256, EMBEDDING))]
    params += [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(n_filters), rng.normal(0, 0.1, (n_filters, len(languages))), np.zeros(len(languages))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for i, k in enumerate(y):
            text = of[k][rng.integers(len(of[k]))]
            n = min(len(text), int(rng.integers(16, WINDOW + 1)))
            at = int(rng.integers(len(text) - n + 1))
            x[i, :n] = np.frombuffer(text, np.uint8, n, at)
        embedding, filters, (bias, weights, offset) = params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) :]
        pooled, places = [], []
        for w, f in zip(WIDTHS, filters):
            responses = sum((embedding @ f[j])[x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            at = responses.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(responses, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + bias
        hidden = np.maximum(raw, 0)
        d_logits = _softmax(hidden @ weights + offset)
        d_logits[np.arange(BATCH), y] -= 1
        d_logits /= BATCH
        d_raw = (d_logits @ weights.T) * (raw > 0)
        grads = [np.zeros_like(embedding)]
        for g, (w, f) in enumerate(zip(WIDTHS, filters)):
            d = d_raw[:, g * FILTERS : (g + 1) * FILTERS]
            d_filter = np.zeros_like(f)
            for j in range(w):
                d_table = np.zeros((256, FILTERS))
                byte = x[np.arange(BATCH)[:, None], places[g] + j]
                np.add.at(d_table, (byte, np.arange(FILTERS)[None, :]), d)
                d_filter[j] = embedding.T @ d_table
                grads[0] += d_table @ f[j].T
            grads.append(d_filter)
        grads += [d_raw.sum(axis=0), hidden.T @ d_logits, d_logits.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    params = [p.astype(np.float32) for p in params]
    return ByteNetwork(languages, params[0], tuple(params[1 : 1 + len(WIDTHS)]), *params[1 + len(WIDTHS) :])


class _Scorer:
    """The network with the tables of two neighbouring bytes added up."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.steps = []
        for t in net.tables():
            self.steps.append([(j, pair(t[j], t[j + 1])) if j + 1 < len(t) else (j, t[j]) for j in range(0, len(t), 2)])

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Log probability of each language for each window."""
        out = []
        for at in range(0, len(windows), 128):
            x = windows[at : at + 128]
            pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for w, steps in zip(WIDTHS, self.steps):
                n = WINDOW - w + 1
                total = None
                for j, t in steps:
                    part = t.take((pairs if len(t) > 256 else x)[:, j : j + n], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            logits = (hidden @ self.net.weights + self.net.offset).astype(np.float64)
            top = logits.max(axis=1, keepdims=True)
            out.append(logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text, from all its windows weighed by their bytes, and its probability."""
        counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        ends = np.cumsum(counts)
        buffer = np.zeros(ends[-1] * WINDOW, np.uint8)
        weights = np.full(ends[-1], WINDOW, np.float64)
        for text, end, n in zip(texts, ends, counts):
            at = (end - n) * WINDOW
            buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
            weights[end - 1] = max(1, len(text) - (n - 1) * WINDOW)
        odds = self.log_odds(buffer.reshape(-1, WINDOW)) * weights[:, None]
        means = np.add.reduceat(odds, ends - counts) / np.add.reduceat(weights, ends - counts)[:, None]
        shares = _softmax(means)
        return shares.argmax(axis=1), shares.max(axis=1)


def _predictions(net: ByteNetwork):
    def run(batches):
        scorer = _Scorer(net)
        names = np.array(net.languages, dtype=object)
        for batch in batches:
            for part, texts in pieces(batch, "text", 1 << 20):
                best, score = scorer.judge(texts)
                yield pa.record_batch({"row": part["row"], "lang_pred": pa.array(names[best], pa.string()), "lang_score": pa.array(score, pa.float64())})

    return run


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1), from every byte of ``text``.

    Null and empty texts, texts without a letter, and all texts if there is no network (nothing to learn from)
    are ``und`` with score 0.  Repeated rows and null ids are judged like any row; columns of those two names are replaced.
    """
    own = ("lang_pred", "lang_score")
    docs = docs.drop(*own)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    unknown = [F.lit(UNKNOWN).alias(own[0]), F.lit(0.0).alias(own[1])]
    if net is None:
        return docs.select(*columns, *unknown)
    # A text without a letter goes along as null, so that nobody waits for its windows.
    rows = docs.select(F.struct(*columns).alias("row"), F.when(letter, F.col("text")).alias("text"), letter.alias("spoken"))
    judged = rows.select(F.struct("row", "spoken").alias("row"), "text").mapInArrow(
        _predictions(net), rows.select(F.struct("row", "spoken").alias("row"), F.lit("").alias(own[0]), F.lit(0.0).alias(own[1])).schema
    )
    spoken = F.col("row.spoken")
    return judged.select("row.row.*", F.when(spoken, F.col(own[0])).otherwise(UNKNOWN).alias(own[0]), F.when(spoken, F.col(own[1])).otherwise(0.0).alias(own[1]))


def learn(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS, passages: int = PASSAGES, languages: int = LANGUAGES) -> ByteNetwork | None:
    """A network from ``docs`` (``doc_id, text, lang``); None if no row has a language, an id and a letter.

    The ``languages`` with most documents are learned, the smaller name first among equals, so that a column with a value of its own for every
    document stays harmless.  Of each about ``sample`` documents are drawn by hashing ids, and of each document ``passages`` passages of
    PASSAGE characters anywhere in the text.  So what reaches the driver is bounded whatever the table holds.
    """
    named = docs.filter("lang is not null and doc_id is not null").filter(F.regexp_like("text", F.lit(r"\p{L}")))
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # At most ``languages`` rows, so that no text is shuffled by language.
    drawn = named.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) * F.col("n") < sample * (1 << 20))
    at = F.pmod(F.xxhash64("doc_id", "i"), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    parts = drawn.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(passages)))).select("lang", "doc_id", "i", F.substring("text", at, F.lit(PASSAGE)).alias("part"))
    rows = sorted((r.lang, r.doc_id, r.i, r.part) for r in parts.collect())
    return train([r[3].encode() for r in rows], [r[0] for r in rows], steps) if rows else None


def held_out() -> Column:
    """Whether a document is kept from learning; a null id is, but has no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document."""
    documents = table(spark, sf, "documents")
    net = learn(documents.select("doc_id", "text", "lang").filter(~held_out()))
    judged = identify(documents.select("doc_id", "text"), net)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
