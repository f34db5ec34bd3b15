"""MinHash near-dedup: the chosen-path similarity join on shingle sets.

Every distinct set has a sketch of minwise tokens.  A tree sends a document from
its root into the node named by one of these tokens; nodes with too many members
branch again, by tokens chosen by hashing the path so far, 1 / threshold on average (1.25 at 0.8), so that two
sets of the target similarity keep meeting while others part.  Small nodes are
compared exhaustively.  Independent trees repeat this to the target recall, ``RECALL`` where all nodes
branch to the last level, which takes ten trees at 0.8; two sets at the threshold share a root's token with
probability 0.8, so these miss a link about once in 10^7 where nodes are small.

Copies never multiply: equal sets are one class; in a node, each member is first held only against the node's
smallest member, and all pairs are looked at only between what these first links have not joined yet.  Nodes that stay
too large are compared tile by tile, every tile with every other, so that none of their pairs is left out; two tiles bring
their sets along and give only the links that join something, so that pairs of a large group are never rows.
A link counts only after it is confirmed on the full sets.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorsight.llm.components import components, extended
from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import as_bytes, mix64, pieces, rolling, word_hashes, _Powers
from priorsight.plans.lineage import cut
from priorsight.plans.ordering import with_global_order

#: Shingle length in words and similarity in percent, as most of the library's callers want them.
WORDS, PERCENT = 5, 80
#: Trees at least, and levels of each.
TREES, LEVELS = 10, 5
#: Of links at the threshold, the share that the trees find even if every node on the way branches.
RECALL = 0.997
#: Members up to which a node is compared exhaustively, a power of two.
NODE = 64
#: Members of a tile of a larger node, about: so many at least, at most, and in between as many as make so many tiles; bytes of a tile's sets.
TILE, MOST, TILES, TILE_BYTES = 512, 4096, 16, 1 << 22
#: Minwise tokens that trees may choose, and tokens of which a sketch keeps the last 4 bits.
TOKENS, SKETCH = 64, 256
#: Of the sketch, so many agree with probability above 0.99996 at similarity 0.8 (mean 208, deviation 6.2).
AGREE = 183
#: Partners from which on a set is confirmed in blocks; bytes of sets in a block; blocks' rows that are sent to every task (16 bytes each).
MANY, BLOCK, SENT = 16, 1 << 18, 1_000_000
_POWERS = _Powers(0x27D4EB2F165667C5 | 1)
_MULTIPLIERS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix64(np.arange(1001, 1001 + SKETCH, dtype=np.uint64))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a text with fewer words, one hash of them all."""
    hashes, borders = word_hashes([t.lower() for t in texts])  # of bytes: A-Z only
    shingles = rolling(hashes, words, _POWERS)
    sets = []
    for a, b in zip(borders, borders[1:]):
        if b - a >= words:
            sets.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:  # its length is mixed in, so that it equals no full shingle
            sets.append(mix64(rolling(hashes[a:b], b - a, _POWERS) + np.uint64(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def minwise(tokens: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: under each of the hash functions, the smallest value."""
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(tokens), 1 << 9):  # slices that stay in the cache
        part = tokens[at : at + (1 << 9), None] * _MULTIPLIERS + _OFFSETS
        least = np.minimum(least, (part >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return least


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                sets = shingle_sets(texts, words)
                low = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                high = np.array([mix64(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                mins = np.array([minwise(s) if len(s) else np.zeros(SKETCH, np.uint32) for s in sets]).reshape(len(sets), SKETCH)
                nibbles = (mins & 15).astype(np.uint64).reshape(len(sets), SKETCH // 16, 16)
                packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
                yield pa.record_batch({
                    "doc_id": part["doc_id"],
                    "text_key": part["text_key"],
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "cls": pa.array(mix64(low).view(np.int64)),
                    "check": pa.array(high.view(np.int64)),
                    "mins": pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(mins[:, :TOKENS]).ravel().view(np.int32)), TOKENS).cast(pa.list_(pa.int32())),
                    "bits": pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel().view(np.int64)), SKETCH // 16).cast(pa.list_(pa.int64())),
                })

    return run


def _packed_sets(words: int):
    """Of each class: its set as 40-bit fingerprints, sorted."""

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                blobs = []
                for s in shingle_sets(texts, words):
                    s = np.sort(s >> np.uint64(24))
                    blobs.append((s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (s >> np.uint64(32)).astype("u1").tobytes())
                yield pa.record_batch({"cls": part["cls"], "shingles": pa.array(blobs, pa.binary())})

    return run


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(np.int64) | np.frombuffer(blob, "u1", n, 4 * n).astype(np.int64) << 32


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = zip(part["set_a"].to_pylist(), part["set_b"].to_pylist())
                keep = [i for i, (x, y) in enumerate(both) if _linked(_unpacked(x), _unpacked(y), percent)]
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _confirmed_cell(percent: int):
    """Of the pairs of a cell, those whose sets, each of which the cell has once, are linked."""

    def run(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        known = {c: _unpacked(s) for c, s in zip(sets["cls"].to_pylist(), sets["shingles"].to_pylist())}
        keep = [i for i, (x, y) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())) if _linked(known[x], known[y], percent)]
        return pairs.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _agreement(x: str, y: str) -> Column:
    """In how many of the minwise tokens' last four bits two sketches agree."""
    differs = lambda i: f"({x}[{i}] ^ {y}[{i}])"
    one = lambda i: f"bit_count(({differs(i)} | shiftrightunsigned({differs(i)}, 1) | shiftrightunsigned({differs(i)}, 2) | shiftrightunsigned({differs(i)}, 3)) & 1229782938247303441L)"
    return F.expr(f"{SKETCH} - (" + " + ".join(one(i) for i in range(SKETCH // 16)) + ")")


def _least_agreement(percent: int) -> int:
    """The bound on agreements is for 80 per cent; lower thresholds lower it by their own mean."""
    return AGREE - 3 * max(0, 80 - percent)


def _similar(percent: int) -> Column:
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    return sizes & (_agreement("x.bits", "y.bits") >= _least_agreement(percent))


def _tile(tile: pa.StructScalar) -> tuple:
    members = tile["members"].values
    field = lambda name: members.field(name).to_numpy()
    bits = members.field("bits").flatten().to_numpy().view(np.uint64).reshape(len(members), SKETCH // 16)
    return field("cls"), field("root"), bits, [_unpacked(s) for s in members.field("shingles").to_pylist()]


def _tiles_linked(percent: int):
    """Of two tiles ``x, y`` of a node (one, if ``i = j``): links that join what their pairs join, at most one less than there are components.

    Pairs apart whose sizes and sketches allow a link are held against each other on their full sets, all partners of a member at
    once; what a link has joined is not looked at again.
    """
    least, ones = _least_agreement(percent), np.uint64(0x1111111111111111)

    def run(key: tuple, pair: pa.Table) -> pa.Table:
        same = pair["i"][0] == pair["j"][0]
        tiles = [_tile(pair[c][0]) for c in ("x" if same else "xy")]
        cls, root, bits = (np.concatenate([t[k] for t in tiles]) for k in range(3))
        sets = [s for t in tiles for s in t[3]]
        n = np.array([len(s) for s in sets])
        begin = np.cumsum(n) - n
        known, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        part, held = np.unique(root, return_inverse=True)[1], np.zeros(len(known), np.uint8)
        links = []
        for a in range(len(tiles[0][0])):
            first = a + 1 if same else len(tiles[0][0])
            allowed = (part[first:] != part[a]) & (n[first:] * 100 >= n[a] * percent) & (n[a] * 100 >= n[first:] * percent)
            b = first + np.flatnonzero(allowed)
            differs = bits[b] ^ bits[a]
            differs |= differs >> np.uint64(1)
            differs |= differs >> np.uint64(2)
            b = b[SKETCH - np.bitwise_count(differs & ones).sum(axis=1, dtype=np.int64) >= least]
            if not len(b):
                continue
            # The tokens of all partners, one after another; those that the member has too are counted for each partner.
            ends = np.cumsum(n[b])
            own = tokens[begin[a] : begin[a] + n[a]]
            held[own] = 1
            hits = held[tokens[np.arange(ends[-1]) + np.repeat(begin[b] - (ends - n[b]), n[b])]]
            held[own] = 0
            shared = np.add.reduceat(hits, ends - n[b], dtype=np.int64)
            b = b[100 * shared >= percent * (n[a] + n[b] - shared)]
            joined, at = np.unique(part[b], return_index=True)
            links += [(cls[a], cls[k]) for k in b[at]]
            part[np.isin(part, joined)] = part[a]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _links_between_tiles(members: DataFrame, joined: DataFrame, light: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: of the nodes of ``members`` (``node, cls``), links that join all that pairs of a node not joined yet can join.

    A component with many members in a node has tiles of its own there, which do not meet each other; the other members share tiles.
    Pairs of tiles are rows of their own, each confirmed where its two tiles are; pairs of members are never listed.
    """
    rooted = members.join(joined, members["cls"] == joined["id"], "left").select("node", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("node")
    rooted = cut(rooted.join(mixed, "node", "left_semi").join(light.select("cls", "n"), "cls"))
    many = rooted.groupBy("node", "root").count().filter(F.col("count") >= TILE).select("node", "root", F.lit(True).alias("own"))
    own = F.coalesce("own", F.lit(False))
    grouped = rooted.join(many, ["node", "root"], "left").select("node", "cls", "root", "n", own.alias("own"), F.when(own, F.col("root")).otherwise(0).alias("group"))
    # A set is moved once for each tile that its own one meets, so large groups have larger tiles.
    count = F.count(F.lit(1))
    tile = F.least(F.greatest(count / TILES, F.lit(TILE)), F.lit(MOST))
    parts = grouped.groupBy("node", "own", "group").agg(F.ceil(F.greatest(count / tile, F.sum("n") * 5 / TILE_BYTES)).alias("parts"))
    part = F.pmod(F.xxhash64("cls", "node"), F.col("parts")).alias("part")
    dealt = cut(grouped.join(parts, ["node", "own", "group"]).select("node", "cls", "root", "own", "group", part))

    # The tiles of a node, numbered; those of one component follow each other.
    node = Window.partitionBy("node")
    listed = dealt.select("node", "own", "group", "part").distinct().withColumn("i", F.row_number().over(node.orderBy("own", "group", "part")))
    listed = listed.withColumn("last", F.count(F.lit(1)).over(node).cast("int")).withColumn("from", F.when(F.col("own"), F.max("i").over(Window.partitionBy("node", "own", "group")) + 1).otherwise(F.col("i")))
    listed = cut(listed)
    pairs = listed.filter("from <= last").select("node", "i", F.explode(F.sequence("from", "last")).alias("j"))

    known = dealt.join(listed.select("node", "own", "group", "part", "i"), ["node", "own", "group", "part"]).join(light, "cls").join(sets, "cls")
    tiles = cut(known.groupBy("node", "i").agg(F.collect_list(F.struct("cls", "root", "bits", "shingles")).alias("members")))
    first = tiles.select("node", "i", F.struct("members").alias("x"))
    second = tiles.select("node", F.col("i").alias("j"), F.struct("members").alias("y"))
    # Groups of one row, so that a task holds two tiles at a time.
    met = pairs.join(first, ["node", "i"]).join(second, ["node", "j"]).select("node", "i", "j", "x", "y")
    return cut(met.groupBy("node", "i", "j").applyInArrow(_tiles_linked(percent), "a long, b long"))


def _together(percent: int, levels: int) -> float:
    """How likely a pair at the threshold shares a last node of a tree if every node branches."""
    alike, kept = percent / 100, 1.0
    whole, part = divmod(100 / percent, 1)
    for _ in range(levels - 1):
        parted = 1 - alike * kept
        kept = 1 - (1 - part) * parted**whole - part * parted ** (whole + 1)
    return alike * kept


def trees_for(percent: int, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Trees that find a link at the threshold with probability ``recall``, ``TREES`` at least."""
    together = _together(percent, levels)
    return TREES if together >= recall else max(TREES, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _nodes(classes: DataFrame, percent: int, trees: int, levels: int) -> DataFrame:
    """``node, cls``: the nodes at which the trees stop, those of a single member left out."""
    roots = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col("mins")[t * 37 % TOKENS].alias("token")) for t in range(trees)]))
    rows = classes.select("cls", roots.alias("r")).select(F.xxhash64("r.tree", "r.token").alias("node"), "cls")
    stopped = []
    for level in range(levels):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        rows = cut(rows.join(sizes, "node"))
        last = level == levels - 1
        stopped.append(rows if last else rows.filter(F.col("members") <= NODE))
        large = rows.filter(F.col("members") > NODE)
        if last or large.isEmpty():
            break
        # The path chooses the whole part of 100 / percent tokens, and with the rest as probability one more.
        whole, part = divmod(100, percent)
        tokens = F.lit(whole) + (F.pmod("node", F.lit(percent)) < part).cast("int")
        chosen = F.explode(F.sequence(F.lit(1), tokens))
        large = large.join(classes.select("cls", "mins"), "cls").withColumn("branch", chosen)
        at = F.pmod(F.xxhash64("node", "branch"), F.lit(TOKENS)).cast("int")
        rows = large.select(F.xxhash64("node", at.alias("at"), F.get("mins", at)).alias("node"), "cls")
    return reduce(DataFrame.unionByName, stopped)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int | None = None, levels: int = LEVELS) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    With A-Z lower-cased, documents are linked if their sets of word shingles have an intersection of at least ``percent`` of their union;
    ``component_id`` is the smallest ``doc_id`` that links reach.  Unless given, the number of trees follows from ``percent`` and ``RECALL``.

    Null texts and texts without words have an empty set, no links and themselves as component; texts with fewer words than a
    shingle have one shingle, the whole sequence; repeated rows are linked; null ids take part but never name a component
    that holds another id; an empty table gives no rows.  Other columns are ignored.  ``text_key`` tells rows with one id apart.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n long, cls long, check long, mins array<int>, bits array<long>"
    sketched = cut(keyed.mapInArrow(_sketches(words), schema))
    full = sketched.filter("n > 0")
    # Equal sets are one class, stood for by one of its rows.
    classes = cut(full.groupBy("cls", "check").agg(F.min(F.struct("doc_id", "text_key", "n", "mins", "bits")).alias("r")).select("cls", "r.*"))
    light = classes.select("cls", "n", "bits")

    # A node with many members left is dealt to blocks of NODE members, in each node anew; their smallest members meet as a block of the node's own.
    shift = F.ceil(F.log2(F.greatest(F.col("members") / NODE, F.lit(1.0)))).cast("int")
    block = F.pmod(F.xxhash64("cls", "node"), F.pow(F.lit(2), shift).cast("long")).alias("block")
    blocks = _nodes(classes, percent, trees or trees_for(percent, levels), levels).select("node", "cls", block, (shift > 0).alias("large"))
    members = cut(blocks.groupBy("node", "block", "cls", "large").count().drop("count"))
    heads = cut(members.groupBy("node", "block").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("size")))
    tops = heads.groupBy("node").agg(F.min("head").alias("top"), F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")
    first = members.join(heads.filter("size > 1"), ["node", "block"]).select(F.col("head").alias("a"), F.col("cls").alias("b"))
    first = first.union(heads.join(tops, "node").select(F.col("top").alias("a"), F.col("head").alias("b")))
    first = _sketch_pairs(first.filter("a <> b").distinct(), light, percent)

    # Only sets that may be linked at all are fetched: those that share a node with another one.
    wanted = members.join(heads.filter("size > 1"), ["node", "block"], "left_semi").select("cls").union(members.filter("large").select("cls")).distinct()
    fetched = classes.join(wanted, "cls", "left_semi").select("cls", F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
    texts = keyed.join(fetched, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))).select("cls", "text")
    sets = cut(texts.mapInArrow(_packed_sets(words), "cls long, shingles binary").dropDuplicates(["cls"]))

    best = first.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a")).select("a", "b")
    links = _confirm(best, sets, percent)
    # What the best of these links have not joined, the others may.
    joined = components(links)
    more = _between(first.join(best, ["a", "b"], "left_anti").select("a", "b"), joined)
    joined = extended(joined, _confirm(more, sets, percent))

    # All pairs of a small node that the first links have not joined.
    labelled = members.filter("not large").join(joined, members["cls"] == joined["id"], "left").select("node", "block", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = labelled.groupBy("node", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("node", "block")
    open_ = cut(labelled.join(mixed, ["node", "block"], "left_semi").join(light, "cls"))
    x, y = open_.alias("x"), open_.alias("y")
    pairs = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & _similar(percent))
    rest = pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    joined = extended(joined, _confirm(rest, sets, percent))
    # Of the larger ones, all pairs that are not joined even then.
    large = members.filter("large").select("node", "cls")
    if not large.isEmpty():
        joined = extended(joined, _links_between_tiles(large, joined, light, sets, percent))

    named = full.select("doc_id", "text_key", "n", "cls").join(joined, F.col("cls") == F.col("id"), "left").withColumn("root", F.coalesce("root", "cls"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "root").select("doc_id", "text_key", "n", "component_id")
    alone = sketched.filter("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return named.union(alone).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _between(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a, b = joined.select(F.col("id").alias("a"), F.col("root").alias("root_a")), joined.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(apart).select("a", "b")


def _sketch_pairs(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link, with the number of agreeing tokens."""
    x, y = light.alias("x"), light.alias("y")
    met = pairs.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).filter(_similar(percent))
    return cut(met.select("a", "b", _agreement("x.bits", "y.bits").alias("alike")))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, many: int = MANY) -> DataFrame:
    """The pairs whose full sets are linked.

    A set with ``many`` partners or more is heavy.  Heavy sets are put into blocks of about ``BLOCK`` bytes, those with one smallest
    partner side by side; pairs of heavy sets are compared in cells of two blocks, to which a set goes once and not once a pair.
    Other pairs bring their sets along: there are fewer than ``many`` for each set that is not heavy.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    ends = pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("partners"), F.min("b").alias("least"))
    heavy = cut(ends.filter(F.col("partners") >= many).select("cls", F.least("least", "cls").alias("least")))
    n_heavy = heavy.count()
    single = pairs
    if n_heavy:
        sized = heavy.join(sets.select("cls", F.octet_length("shingles").cast("long").alias("bytes")), "cls")
        blocks = cut(with_global_order(sized, ["least", "cls"], ["bytes"]).select("cls", F.floor(F.col("run_bytes") / BLOCK).alias("block")))
        if n_heavy <= SENT:
            blocks = F.broadcast(blocks)
        of = lambda end: blocks.select(F.col("cls").alias(end), F.col("block").alias(f"block_{end}"))
        placed = cut(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left"))
        dense = F.col("block_a").isNotNull() & F.col("block_b").isNotNull()
        single = placed.filter(~dense).select("a", "b")
        # Both ends of a pair keep their sides; the cell is named by its blocks in order.
        cells = placed.filter(dense).select("a", "b", F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j"))
        wanted = cells.select(F.col("i").alias("row"), F.col("j").alias("column"), F.explode(F.array("a", "b")).alias("cls")).distinct()
        # At most two rows a pair; the sets stay where they are if these are few.
        wanted = sets.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "cls")
        compared = cells.groupBy("i", "j").cogroup(wanted.groupBy("row", "column")).applyInArrow(_confirmed_cell(percent), "a long, b long")
    # Few pairs go to the sets, so that no other set moves.
    few = F.broadcast if single.count() <= SENT else lambda df: df
    side = lambda end: sets.join(few(single.withColumn("cls", F.col(end))), "cls").select("a", "b", F.lit(end).alias("end"), "shingles")
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("shingles"))).alias(f"set_{end}")
    met = side("a").union(side("b")).groupBy("a", "b").agg(at("a"), at("b"))
    found = met.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")
    return cut(found.union(compared) if n_heavy else found)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, that with the smallest id, and every row without words, which is linked with nothing.

    Of repeated rows with words one stays; the columns are those of ``docs``.
    """
    found = cut(near_duplicates(docs, words, percent))
    worded = found.filter("kept and n_shingles > 0")
    stays = worded.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("s"), F.count(F.lit(1)).alias("rows"))
    stays = stays.select("s.doc_id", "s.text_key", (F.col("rows") > 1).alias("repeated")).union(found.filter("n_shingles = 0").select("doc_id", "text_key", F.lit(False)).distinct())
    stays = stays.toDF("of_doc", "of_text", "repeated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("in_doc"), F.xxhash64("text").alias("in_text"))
    met = rows.join(stays, F.col("in_doc").eqNullSafe(F.col("of_doc")) & F.col("in_text").eqNullSafe(F.col("of_text")))
    if not stays.filter("repeated").isEmpty():
        alone = F.when(F.col("repeated"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
        met = met.withColumn("alone", alone).dropDuplicates(["in_doc", "in_text", "alone"])
    return met.select("row.*")


def _sql(words: int, percent: int) -> str:
    """Documents with equal sets are one class; links of classes that share a shingle are counted, and followed to all that is reachable."""
    return f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + {words - 1}], ' ') for i in range(1, len(w) - {words - 2})] end)) as held from d),
c as (select held, min(doc_id) as cls, len(held) as n from s where len(held) > 0 group by held),
x as (select cls, n, unnest(held) as t from c),
p as (select a.cls as a, b.cls as b from x a join x b on a.t = b.t and a.cls < b.cls group by a.cls, b.cls, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r(a, b) as (select cls, cls from c union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) as least from r group by a)
select doc_id, len(s.held)::bigint as n_shingles, coalesce(least, doc_id) as component_id, coalesce(least, doc_id) = doc_id as kept
from s left join c on c.held = s.held left join m on m.a = c.cls"""


@query("op6_near_dedup", _sql(4, PERCENT))
def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents, on shingles of four words."""
    found = near_duplicates(table(spark, sf, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
