"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a public byte-fallback BPE model file, read on the driver and
broadcast (its size is fixed by the model).  A text is cut where no piece can reach across: before a
space that follows another character, and around line ends.  In such a chunk, the agenda takes the best-scored
merge first, the leftmost among equals; a candidate merge is skipped if the keyed hash of (seed, the document's
key, the chunk's place in it, the merge's borders) falls below the dropout rate.  Every occurrence of a chunk draws
for itself, and every rerun agrees.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import mix64, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
#: Chunks of more characters go through a heap instead of the matrix, whose work is quadratic in the length.
LONG = 48
#: Bytes of text that are segmented together; the more, the more occurrences share their ways.
SLICE = 1 << 22
CHUNK = re.compile("[ ]*[^ \n▁]+|[ ]+|\n|▁")
_NO_PIECE, _BITS = 32767, 15
_NEVER = np.int32(2**31 - 1)
_CODE = np.uint64(0x9E3779B97F4A7C15)
_MASK = 2**64 - 1


def _limit(dropout: float) -> int:
    """Draws below this are skipped."""
    return min(int(dropout * _MASK), _MASK)


def _draw(key: int, first: int, last: int) -> int:
    """What ``mix64`` gives for one candidate merge, in plain numbers."""
    x = key ^ ((first << 32 | last) * int(_CODE) & _MASK)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


@dataclass
class Pieces:
    """A model's pieces as arrays: single characters, merges sorted by (left id, right id), and bytes for decoding."""

    chars: dict[str, int]
    pairs: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    first_byte: int

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n >= _NO_PIECE:
            raise ValueError(f"{path} has {n} pieces; at most {_NO_PIECE - 1} are supported")
        text = {i: model.id_to_piece(i).replace("▁", " ") for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        ids = {t: i for i, t in text.items()}
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in text}, reverse=True))}
        found = {}
        for i, t in text.items():
            for cut in range(1, len(t)):
                left, right = ids.get(t[:cut]), ids.get(t[cut:])
                if left is not None and right is not None:
                    found[left << _BITS | right] = (order[model.get_score(i)], i)
        pairs = np.array(sorted(found), np.int64)
        first_byte = next(i for i in range(n) if model.is_byte(i))
        raw = [text[i].encode() if i in text else bytes([i - first_byte]) if model.is_byte(i) else b"" for i in range(n)]
        return Pieces(
            {t: i for t, i in ids.items() if len(t) == 1}, pairs, np.array([found[p][0] for p in pairs.tolist()], np.int32), np.array([found[p][1] for p in pairs.tolist()], np.int32),
            np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), first_byte,
        )

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each two neighbours make; rank ``_NEVER`` if none."""
        wanted = left.astype(np.int64) << _BITS | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank[at], _NEVER), self.merged[at]

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pairs.tolist(), zip(self.rank.tolist(), self.merged.tolist())))

    def agenda(self, chunk: str, key: int, dropout: float) -> list[int]:
        """The pieces of one chunk, by a heap of candidate merges; time n log n."""
        ids = [self.chars.get(c, _NO_PIECE) for c in chunk]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(range(1, n + 1))
        table, limit = self.table, _limit(dropout)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (made := table.get(ids[i] << _BITS | ids[j])):
                heapq.heappush(heap, (made[0], i, ends[j], made[1]))

        for i in range(n):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, end, piece = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or ends[after[i]] != end or _draw(key, i, end) < limit:
                continue
            j = after[i]
            alive[j], ids[i], ends[i], after[i] = False, piece, end, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return self._spelled([ids[i] for i in range(n) if alive[i]], [i for i in range(n) if alive[i]], chunk)

    def _spelled(self, ids: list[int], starts: list[int], chunk: str) -> list[int]:
        """Characters that are no piece as their UTF-8 bytes."""
        out: list[int] = []
        for i, s in zip(ids, starts):
            if i == _NO_PIECE:
                out += [self.first_byte + b for b in chunk[s].encode()]
            else:
                out.append(i)
        return out

    def segment(self, chunks: list[str], variants: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all chunks, one after another, and how many each has; equal variants draw alike."""
        keys = mix64(np.asarray(variants).astype(np.uint64) * _CODE + np.uint64(seed & _MASK))
        flat, counts, leaf = self.segment_each(chunks, np.arange(len(chunks)), keys, dropout)
        starts = np.cumsum(counts) - counts
        return _gathered(flat, starts[leaf], counts[leaf]), counts[leaf]

    def segment_each(self, chunks: list[str], of: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of every occurrence: occurrence ``o`` is of chunk ``of[o]`` and draws by ``keys[o]``.

        Occurrences of one chunk go the same way until a draw parts them, so each way is gone once: a row of a matrix is
        a state of the agenda, and in each step some of its occurrences merge the best candidate and some skip it.
        All rows of a matrix have as many pieces left.  Returns the ids of all ends, how many each has, and the end of each occurrence.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of ends, and their ids
        leaf = np.empty(len(of), np.int64)
        n_ends = 0

        def end(chunk: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> int:
            nonlocal n_ends
            numbers = np.arange(n_ends, n_ends + len(chunk))
            n_ends += len(chunk)
            spell = (ids == _NO_PIECE).any(axis=1)
            for number, c, i, s in zip(*(x[spell].tolist() for x in (numbers, chunk, ids, starts))):
                ends.append((np.array([number]), np.array([self._spelled(i, s, chunks[c])])))
            ends.append((numbers[~spell], ids[~spell]))
            return n_ends - len(chunk)

        order = np.argsort(lengths[of], kind="stable")
        borders = np.searchsorted(lengths[of][order], np.arange(lengths.max(initial=0) + 2))
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            occ = order[borders[length] : borders[length + 1]]
            if length > LONG:
                found = {}
                for o, c, k in zip(occ.tolist(), of[occ].tolist(), keys[occ].tolist()):
                    way = c, k if dropout > 0 else 0
                    if way not in found:
                        found[way] = n_ends
                        ends.append((np.array([n_ends]), np.array([self.agenda(chunks[c], k, dropout)])))
                        n_ends += 1
                    leaf[o] = found[way]
                continue
            number = np.zeros(len(chunks), np.int64)
            number[rows] = np.arange(len(rows))
            node = number[of[occ]]
            codes = np.frombuffer("".join([chunks[r] for r in rows.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
            seen, back = np.unique(codes, return_inverse=True)
            char, back = np.array([self.chars.get(chr(c), _NO_PIECE) for c in seen.tolist()], np.int32), back.reshape(codes.shape)
            ids = char[back]
            starts = np.broadcast_to(np.arange(length + 1, dtype=np.int32), (len(rows), length + 1))
            if len(seen) ** 2 <= codes.size:
                rank, made = self.merges(np.repeat(char, len(seen)), np.tile(char, len(seen)))
                pair = back[:, :-1] * len(seen) + back[:, 1:]
                state = rows, ids, starts, rank[pair], made[pair]
            else:
                state = (rows, ids, starts, *self.merges(ids[:, :-1], ids[:, 1:]))
            for width in range(length, 1, -1):
                merging: list[tuple] = []  # states, the candidate each merges, its occurrences and their states
                n_merging = 0
                while len(state[0]):
                    rank = state[3]
                    at = rank.argmin(axis=1)
                    each = np.arange(len(at))
                    going = rank[each, at] != _NEVER
                    merges, skipping = going, ~going
                    if skipping.any():
                        first = end(*(x[skipping] for x in state[:3]))
                        over = skipping[node]
                        leaf[occ[over]] = first + (np.cumsum(skipping) - 1)[node[over]]
                        occ, node = occ[~over], node[~over]
                    if dropout > 0:
                        borders_of = state[2][each, at].astype(np.uint64) << np.uint64(32) | state[2][each, np.minimum(at + 2, width)].astype(np.uint64)
                        skips = mix64(keys[occ] ^ (borders_of * _CODE)[node]) < np.uint64(_limit(dropout))
                        merges, skipping = np.zeros(len(at), bool), np.zeros(len(at), bool)
                        merges[node[~skips]] = True
                        skipping[node[skips]] = True
                    else:
                        skips, skipping = np.zeros(len(occ), bool), np.zeros(len(at), bool)
                    merging.append((self._merged(merges, at, *state), at[merges], occ[~skips], (np.cumsum(merges) - 1)[node[~skips]] + n_merging))
                    n_merging += len(merging[-1][1])
                    state, at = tuple(x[skipping] for x in state), at[skipping]
                    state[3][np.arange(len(at)), at] = _NEVER
                    occ, node = occ[skips], (np.cumsum(skipping) - 1)[node[skips]]
                if not n_merging:
                    break
                state = self._renewed(np.concatenate([m[1] for m in merging]), *(np.concatenate(x) for x in zip(*(m[0] for m in merging))))
                occ, node = np.concatenate([m[2] for m in merging]), np.concatenate([m[3] for m in merging])
            if len(occ):  # one piece is left of each
                leaf[occ] = end(*state[:3]) + node
        counts = np.zeros(n_ends, np.int64)
        for numbers, ids in ends:
            counts[numbers] = ids.shape[1]
        first_id = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for numbers, ids in ends:
            flat[first_id[numbers][:, None] + np.arange(ids.shape[1])] = ids
        return flat, counts, leaf

    @staticmethod
    def _merged(which, at, chunk, ids, starts, rank, merged) -> tuple:
        """Those states of ``which``, each with its candidate ``at`` merged."""
        width, column = ids.shape[1], np.arange(starts.shape[1])
        n = int(which.sum())
        keep = (column != (at + 1)[:, None]) & which[:, None]
        out = ids[keep[:, :-1]].reshape(n, width - 1)
        rows, at_which = np.flatnonzero(which), at[which]
        out[np.arange(n), at_which] = merged[rows, at_which]
        candidates = keep[:, 1:-1]
        return chunk[which], out, starts[keep].reshape(n, width), rank[candidates].reshape(n, width - 2), merged[candidates].reshape(n, width - 2)

    def _renewed(self, at, chunk, ids, starts, rank, merged) -> tuple:
        """The states with the candidates beside the piece ``at``, which was just made, made anew."""
        each, width = np.arange(len(at)), ids.shape[1]
        for where, there in ((at - 1, at > 0), (at, at < width - 1)):
            e, p = each[there], where[there]
            rank[e, p], merged[e, p] = self.merges(ids[e, p], ids[e, p + 1])
        return chunk, ids, starts, rank, merged


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _gathered(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``data`` that begin at ``starts``, one after another."""
    ends = np.cumsum(counts)
    return data[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _listed(values: pa.Array, counts: np.ndarray, missing: list[bool], of) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.array(missing + [False]))
    return of.from_arrays(offsets, values)


def _encoder(shared, seed: int, dropout: float):
    def run(batches):
        model: Pieces = shared.value
        for batch in batches:
            for part, raw in pieces(batch, "text", SLICE):
                known = _Numbers()
                seen: list[int] = []
                per_text = np.zeros(len(raw), np.int64)
                for i, t in enumerate(raw):
                    chunks = CHUNK.findall(" " + t.decode()) if t else []
                    per_text[i] = len(chunks)
                    seen += map(known.__getitem__, chunks)
                ends = np.cumsum(per_text)
                place = np.arange(len(seen)) - np.repeat(ends - per_text, per_text)
                key = np.array([k or 0 for k in part["key"].to_pylist()], np.int64).view(np.uint64)
                draws = mix64(np.repeat(key, per_text) + place.astype(np.uint64) * _CODE + np.uint64(seed & _MASK))
                ids, counts, back = model.segment_each(list(known), np.array(seen, np.int64), draws, dropout)
                starts = np.cumsum(counts) - counts
                flat = _gathered(ids, starts[back], counts[back])
                sums = np.concatenate(([0], np.cumsum(counts[back])))
                bounds = sums[np.concatenate(([0], ends))]
                missing = part["text"].is_null().to_pylist()
                yield pa.record_batch({"row": part["row"], "ids": _listed(pa.array(flat, pa.int32()), np.diff(bounds), missing, pa.ListArray)})

    return run


def _decoder(shared):
    def run(batches):
        model: Pieces = shared.value
        sizes = np.diff(model.starts)
        for batch in batches:
            lists = batch["ids"]
            for at in range(0, len(lists), 256):
                some = lists.slice(at, 256)
                ids = some.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                per = np.array([n or 0 for n in pa.compute.list_value_length(some).to_pylist()], np.int64)
                data = _gathered(model.data, model.starts[ids], sizes[ids])
                bounds = np.concatenate(([0], np.cumsum(sizes[ids])))[np.concatenate(([0], np.cumsum(per)))]
                raw = data.tobytes()
                texts = [None if gone else raw[a + 1 : b] for a, b, gone in zip(bounds, bounds[1:], some.is_null().to_pylist())]
                yield pa.record_batch({"row": batch["row"].slice(at, 256), "decoded": pa.array([t if t is None else t.decode(errors="replace") for t in texts], pa.string())})

    return run


def encode(docs: DataFrame, model: Pieces, seed: int = SEED, dropout: float = DROPOUT, reading: Column | None = None) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of ``text``; without dropout they are those of the model's own library.

    Every occurrence of a chunk draws for itself, by ``doc_id``, ``reading`` (say, how often the document came before) and place.
    A null text has null ids, an empty one none.  Repeated rows of one ``doc_id`` get the same ids unless ``reading`` tells them apart; rows with null ids share a key.  A
    literal U+2581, which the library reads as a space, is spelled in bytes, so that decoding is lossless.
    """
    docs = docs.drop("ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = ([F.col("doc_id")] if "doc_id" in docs.columns else []) + ([reading] if reading is not None else [])
    key = (F.xxhash64(*named) if named else F.lit(0).cast("long")).alias("key")
    fed = docs.select(row, "text", key)
    out = fed.select("row", F.array(F.lit(0)).alias("ids")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _nullable(fed.mapInArrow(_encoder(shared, seed, dropout), _all_nullable(out)))


def decode(encoded: DataFrame, model: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``, the text its ``ids`` came from; null for null."""
    encoded = encoded.drop("decoded")
    fed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), "ids")
    out = fed.select("row", F.lit("").alias("decoded")).schema
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    return _nullable(fed.mapInArrow(_decoder(shared), _all_nullable(out)))


def _all_nullable(schema):
    for f in schema.fields:
        f.nullable = True
    return schema


def _nullable(df: DataFrame) -> DataFrame:
    return df.select("row.*", *[c for c in df.columns if c != "row"])


@query("op5_sentence_pieces")
def op5_sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's piece ids under dropout, and whether they decode to its text."""
    model = Pieces.load()
    done = decode(encode(table(spark, sf, "documents").select("doc_id", "text"), model), model)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
