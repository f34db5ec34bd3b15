"""Cross-tokenizer alignment: which tokens of two vocabularies end together, counted over the corpus.

Equal texts are brought together by their full text and tokenised once; every count is weighted by how many
documents share the text, and the measures go back to all of them.  A text that too many rows share for one task
(``heavy.part``) is tokenised from its pivot, and its rows never meet.

Two tokens that end together are linked; of the bytes of one, those of the other are a suffix.  So the pairs that can be
linked are bounded by the vocabularies alone, and the table of their counts is small whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.llm.heavy import HEAVY, SENT, part
from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import pieces
from priorsight.plans.lineage import cut

BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNBROKEN = re.compile(r"\S{400}|\s{400}")
_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: A pair of ids is one number, the second id in its lower bits.
_BITS = 31


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others for 256, 257, ..."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Vocabulary:
    """Bytes of every token, one after another, and the ids' decimal digits, each with three ends."""

    data: np.ndarray
    starts: np.ndarray
    digits: np.ndarray
    digit_starts: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Vocabulary:
        spelled = [str(i).encode() + end for end in (b",", b"|", b";") for i in range(len(tokens))]
        return Vocabulary(
            np.frombuffer(b"".join(tokens), np.uint8), _borders(len(t) for t in tokens), np.frombuffer(b"".join(spelled), np.uint8), _borders(len(s) for s in spelled)
        )

    def __len__(self) -> int:
        return len(self.starts) - 1


def _borders(lengths) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64))))


class BytePairs:
    """A byte-level BPE from its JSON file; a space goes before each text, and special tokens are never made from a text.

    Where the file's merges are numbered in their order, as ranks, a faster library does the same by ranks; texts with a long
    unbroken run, in which that library takes quadratic time, stay with the file's own.
    """

    def __init__(self, path: str = BYTE_MODEL):
        self.path, self._model, self._ranked = path, None, None

    def __reduce__(self):
        return BytePairs, (self.path,)

    def model(self):
        if self._model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
            self._model.encode_special_tokens = True
            self._ranked = self._by_rank()
        return self._model

    def _by_rank(self):
        with open(self.path, encoding="utf-8") as f:
            declared = json.load(f)
        ids, cutter = declared["model"]["vocab"], declared.get("pre_tokenizer") or {}
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in declared["model"]["merges"]]
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not declared.get("normalizer")
        if not plain or merged != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        alphabet, special = _byte_alphabet(), {t["content"] for t in declared.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in ids.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def vocabulary(self) -> Vocabulary:
        with open(self.path, encoding="utf-8") as f:
            declared = json.load(f)
        alphabet = _byte_alphabet()
        ids = dict(declared["model"]["vocab"])
        special = {t["id"]: t["content"].encode() for t in declared.get("added_tokens", [])}
        tokens = [b""] * (max([*ids.values(), *special]) + 1)
        for text, i in ids.items():
            tokens[i] = special[i] if i in special else bytes(alphabet[c] for c in text)
        for i, raw in special.items():
            tokens[i] = raw
        return Vocabulary.of(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        model = self.model()
        slow = [i for i, t in enumerate(texts) if self._ranked is None or UNBROKEN.search(t)]
        own = set(slow)
        out = [[] if i in own else self._ranked.encode_ordinary(" " + t) for i, t in enumerate(texts)]
        for i, e in zip(slow, model.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False)):
            out[i] = e.ids
        return out


class WordPieces:
    """A SentencePiece model with byte fallback, which puts the space before a text itself."""

    def __init__(self, path: str = PIECE_MODEL):
        self.path, self._model = path, None

    def __reduce__(self):
        return WordPieces, (self.path,)

    def model(self):
        if self._model is None:
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._model

    def vocabulary(self) -> Vocabulary:
        model = self.model()
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return Vocabulary.of([bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model().encode(texts, num_threads=1)


def _gathered(data: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs [starts[i], starts[i + 1]) of ``data`` for each chosen i, one after another."""
    begin = starts[chosen]
    counts = starts[chosen + 1] - begin
    ends = np.cumsum(counts)
    return data[np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class _Side:
    """One tokenizer's tokens of several texts: ids, the text of each, and the byte at which it ends."""

    def __init__(self, ids: list[list[int]], words: Vocabulary):
        self.counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.counts.sum()))
        self.words = words
        lengths = words.starts[self.ids + 1] - words.starts[self.ids]
        self.ends = np.cumsum(lengths)
        self.sizes = np.concatenate(([0], self.ends))[np.concatenate(([0], np.cumsum(self.counts)))]

    def bytes(self) -> bytes:
        return _gathered(self.words.data, self.words.starts, self.ids).tobytes()

    def only(self, texts: np.ndarray, words: Vocabulary) -> _Side:
        side = _Side.__new__(_Side)
        of = np.repeat(texts, self.counts)
        side.words, side.ids = words, self.ids[of]
        side.counts = np.where(texts, self.counts, 0)
        side.ends = np.cumsum(words.starts[side.ids + 1] - words.starts[side.ids])
        side.sizes = np.concatenate(([0], side.ends))[np.concatenate(([0], np.cumsum(side.counts)))]
        return side


def align_texts(texts: list[str], a: BytePairs, b: WordPieces, words_a: Vocabulary, words_b: Vocabulary) -> list[dict]:
    """Per text: tokens of both sides, groups, their digest, and the linked pairs with how often each occurs.

    A text whose tokens spell other bytes than a space and itself on either side has no tokens.
    """
    side_a, side_b = _Side(a.encode(texts), words_a), _Side(b.encode(texts), words_b)
    raw = [b" " + t.encode() if t else b"" for t in texts]
    all_a, all_b = side_a.bytes(), side_b.bytes()
    true = np.array([
        bool(t) and all_a[p:q] == t and all_b[r:s] == t
        for t, p, q, r, s in zip(raw, *(x.tolist() for x in (side_a.sizes[:-1], side_a.sizes[1:], side_b.sizes[:-1], side_b.sizes[1:])))
    ], bool)
    # Both sides now spell the same bytes, so places in them can be compared.
    side_a, side_b = side_a.only(true, words_a), side_b.only(true, words_b)
    size = int(side_a.sizes[-1])
    ends_a, ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    ends_a[side_a.ends], ends_b[side_b.ends] = True, True
    last_a, last_b = ends_b[side_a.ends], ends_a[side_b.ends]  # tokens that end a group
    text_of = np.repeat(np.arange(len(texts)), side_a.counts)[last_a]
    n_groups = np.bincount(text_of, minlength=len(texts))
    pairs = side_a.ids[last_a] << _BITS | side_b.ids[last_b]
    # A token of A comes after all earlier tokens of A and the tokens of B in earlier groups, one of B after those of A up to its group.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    b_upto = np.concatenate(([0], np.flatnonzero(last_b) + 1))
    a_upto = np.concatenate(([0], np.flatnonzero(last_a) + 1))
    place_a = np.arange(len(group_a)) + b_upto[group_a]
    place_b = np.arange(len(group_b)) + a_upto[group_b + 1]
    total = len(group_a) + len(group_b)
    lengths, which = np.empty(total, np.int64), np.empty(total, np.int64)
    spelled_a, spelled_b = side_a.ids + last_a * len(words_a), side_b.ids + last_b * 2 * len(words_b)
    which[place_a], which[place_b] = spelled_a, spelled_b + len(words_a) * 3
    starts = np.concatenate((words_a.digit_starts, words_b.digit_starts[1:] + words_a.digit_starts[-1]))
    lengths = starts[which + 1] - starts[which]
    lines = _gathered(np.concatenate((words_a.digits, words_b.digits)), starts, which).tobytes()
    borders = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(side_a.counts + side_b.counts)))].tolist()
    # Occurrences of one pair in one text, by a stable order of pairs and then texts.
    order = np.lexsort((pairs, text_of))
    p, t = pairs[order], text_of[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(p)))
    of_text = np.concatenate(([0], np.cumsum(np.bincount(t[at], minlength=len(texts))))).tolist()
    p = p[at]
    return [
        {
            "n_a": na, "n_b": nb, "n_groups": ng, "pairs": p[of_text[i] : of_text[i + 1]], "times": times[of_text[i] : of_text[i + 1]],
            "groups_sha256": hashlib.sha256(lines[borders[i] : borders[i + 1] - 1]).hexdigest() if na else "",
        }
        for i, (na, nb, ng) in enumerate(zip(side_a.counts.tolist(), side_b.counts.tolist(), n_groups.tolist()))
    ]


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """The linked pairs of a text, rising, and how often each occurs, compressed; ``_unpacked`` needs their number."""
    return pa.compress(np.concatenate((np.diff(pairs, prepend=0), times)).tobytes(), "zstd", asbytes=True)


def _unpacked(links: pa.Array, n_pairs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of all texts of a batch, one text after another, and the borders between texts."""
    counts = n_pairs.to_pylist()
    each = [np.frombuffer(pa.decompress(packed, 16 * n, "zstd"), np.int64) for packed, n in zip(links.to_pylist(), counts) if n]
    halves = [(x[: len(x) // 2].cumsum(), x[len(x) // 2 :]) for x in each]
    empty = [np.empty(0, np.int64)]
    return np.concatenate([x for x, _ in halves] + empty), np.concatenate([x for _, x in halves] + empty), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _aligner(shared):
    def run(batches):
        a, b, words_a, words_b = shared.value
        for batch in batches:
            for some, raw in pieces(batch, "content", 1 << 20):
                done = align_texts([t.decode() for t in raw], a, b, words_a, words_b)
                counts = {c: pa.array([d[c] for d in done], pa.int64()) for c in ("n_a", "n_b", "n_groups")}
                yield pa.record_batch({
                    "rows": some["rows"], "hash": some["hash"], "n": some["n"], **counts, "groups_sha256": pa.array([d["groups_sha256"] for d in done], pa.string()),
                    "n_pairs": pa.array([len(d["pairs"]) for d in done], pa.int64()),
                    "links": pa.array([_packed(d["pairs"], d["times"]) if len(d["pairs"]) else b"" for d in done], pa.binary()),
                })

    return run


def _counted(batches):
    """Links of every pair over all rows of a batch."""
    for batch in batches:
        pairs, times, borders = _unpacked(batch["links"], batch["n_pairs"])
        keys, back = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, back, times * np.repeat(batch["n"].to_numpy(), np.diff(borders)))
        yield pa.record_batch({"pair": pa.array(keys), "count": pa.array(sums)})


def _measurer(shared):
    def run(batches):
        keys, counts, best = shared.value
        for batch in batches:
            pairs, times, borders = _unpacked(batch["links"], batch["n_pairs"])
            at = np.searchsorted(keys, pairs)
            sums = np.concatenate(([0], np.cumsum(times * counts[at])))[borders]
            bests = np.concatenate(([0], np.cumsum(times * best[at])))[borders]
            named = {c: batch[c] for c in ("rows", "hash", "n_a", "n_b", "n_groups")}
            yield pa.record_batch({
                **named, "n_links": batch["n_groups"], "n_best": pa.array(np.diff(bests)), "count_sum": pa.array(np.diff(sums)), "groups_sha256": batch["groups_sha256"],
            })

    return run


def align(docs: DataFrame, columns: Sequence[str] | None = None, a: BytePairs | None = None, b: WordPieces | None = None, heavy: int = HEAVY, sent: int = SENT) -> tuple[DataFrame, DataFrame]:
    """Measures of every row of ``docs`` (its ``columns``, or all), and the corpus-wide counts ``a_id, b_id, count, best``.

    A group is the stretch between two bytes at which tokens of both sides end; the tokens that end there are a link (so links are as many
    as groups).  ``count``: links of a pair over all rows; ``best``: no pair with this ``b_id`` has more (ties share it).  ``n_best`` are a
    row's links that are best, ``count_sum`` adds up their counts.  ``groups_sha256`` digests ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that one side does not spell byte for byte, have no tokens: zeros and an empty digest.  Repeated
    rows count as often as they occur and share their measures.  An empty table gives no rows.  Columns of the measures' names are replaced.
    """
    a, b = a or BytePairs(), b or WordPieces()
    docs = docs.drop(*_MEASURES)
    columns = [c for c in docs.columns if c in columns] if columns is not None else docs.columns
    spark = docs.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in columns])
    some = docs.filter("octet_length(text) > 0").select(kept.alias("row"), F.col("text").alias("content"))
    parted = part(some, heavy, sent)
    # A light text has rows of at most ``parted.most`` bytes, so its list is bounded.
    light = parted.light.groupBy("content").agg(F.collect_list("row").alias("rows")).withColumns({"hash": F.lit(None).cast("long"), "n": F.size("rows").cast("long")})
    shares = parted.heavy.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    many = parted.pivots.join(shares, "hash").withColumn("rows", F.lit(None).cast(light.schema["rows"].dataType))
    texts = light.unionByName(many)
    out = T.StructType([T.StructField("rows", light.schema["rows"].dataType), T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())])
    for c in ("n_a", "n_b", "n_groups"):
        out.add(c, T.LongType())
    out.add("groups_sha256", T.StringType()).add("n_pairs", T.LongType()).add("links", T.BinaryType())
    models = spark.sparkContext.broadcast((a, b, a.vocabulary(), b.vocabulary()))
    aligned = cut(texts.mapInArrow(_aligner(models), out))
    totals = aligned.select("n", "n_pairs", "links").mapInArrow(_counted, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    # One of two linked tokens is a suffix of the other: at most one pair for each byte of both vocabularies (and one more for each spelling of a byte).
    counted = totals.orderBy("pair").toArrow()
    keys, counts = (counted[c].to_numpy().astype(np.int64) for c in ("pair", "count"))
    second = keys & ((1 << _BITS) - 1)
    most = np.zeros(int(second.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, second, counts)
    best = (counts == most[second]).astype(np.int64)
    known = spark.sparkContext.broadcast((keys, counts, best))
    measured = T.StructType([out["rows"], out["hash"]])
    for c in _MEASURES[:-1]:
        measured.add(c, T.LongType())
    measures = aligned.mapInArrow(_measurer(known), measured.add("groups_sha256", T.StringType()))
    each = measures.filter("hash is null").select(F.explode("rows").alias("row"), *_MEASURES)
    # One row for each heavy hash, at most heavy.HEAVIEST.
    of_many = parted.heavy.join(F.broadcast(cut(measures.filter("hash is not null").drop("rows"))), "hash").select("row", *_MEASURES)
    zeros = {c: F.lit(0).cast("long") for c in _MEASURES[:-1]} | {"groups_sha256": F.lit("")}
    without = docs.filter("text is null or octet_length(text) = 0").select(kept.alias("row")).withColumns(zeros)
    pairs = spark.createDataFrame(
        pa.table({"a_id": keys >> _BITS, "b_id": second, "count": counts, "best": best.astype(bool)}), "a_id long, b_id long, count long, best boolean"
    )
    return each.union(of_many).union(without).select("row.*", *_MEASURES), pairs


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The alignment of two tokenizers over every document."""
    return align(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])[0]
