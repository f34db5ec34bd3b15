"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates.

Blocks are the lines and the paragraphs (between empty lines) of whole texts.  A block meets a template if it holds at
least ``CONTAINMENT`` of the template's distinct words and has at most ``SPREAD`` times as many.  A paragraph of more words
is also cut, for each template, into overlapping windows of that many words, so that any stretch as long as the template
lies whole in one of them: a notice is found wherever it stands.  A window stands for its own template only.
Words are ordered by their frequency over the whole corpus, rarest first.  If a block meets a template, their
first words in this order share one (prefix filter); from there on both must have enough words left (positional
filter), and a block must have enough words at all (length filter).  What passes is verified on the whole sets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.llm.wordhash import pieces
from priorsight.plans.lineage import cut

CONTAINMENT, SPREAD = 0.8, 3
BROADCAST_RANKS = 2_000_000  # numbers in the index of templates that still go to every task
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices and the usual one-line forms.
TEMPLATES = {
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-line": "Released under the MIT License",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "reserved": "All rights reserved",
}
_LETTERS = rb"0-9a-z\x80-\xff"
_WORD = re.compile(rb"[%s]+" % _LETTERS)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(text: str) -> list[str]:
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


def template_sets(templates: Mapping[str, str]) -> dict[str, list[str]]:
    return {name: sorted(set(words_of(text))) for name, text in templates.items()}


def least_overlap(size: int, containment: float = CONTAINMENT) -> int:
    return max(1, math.ceil(size * containment - 1e-9))


def _counter(vocabulary: frozenset[bytes]):
    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for _, texts in pieces(batch, "text"):
                for t in texts:
                    total.update(w for w in _WORD.findall(t.lower()) if w in vocabulary)
            yield pa.record_batch({"word": pa.array([w.decode() for w in total], pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def window_plan(templates: Mapping[str, str], spread: int = SPREAD, containment: float = CONTAINMENT) -> dict[str, tuple[int, int, int]]:
    """``{template: (words of a window, step between windows, least overlap)}``.

    A window has as many words as a block may have, and the template's own length more than the step.
    """
    plan = {}
    for name, text in templates.items():
        words = words_of(text)
        size = max(spread * len(set(words)), len(words) + 1)
        plan[name] = size, size - len(words), least_overlap(len(set(words)), containment)
    return plan


def _blocks(text: bytes, ranks: Mapping[bytes, int], windows: Sequence[tuple]):
    """Distinct words of each line, of each paragraph of more than one line, and of the windows of long paragraphs that hold enough."""
    for paragraph in text.split(b"\n\n"):
        lines = [_WORD.findall(line) for line in paragraph.split(b"\n")]
        yield from ((None, set(line)) for line in lines)
        words = list(chain.from_iterable(lines)) if len(lines) > 1 else lines[0]
        if len(lines) > 1:
            yield None, set(words)
        number = np.fromiter((ranks.get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(number >= 0)
        for name, size, step, need, in_template in windows:
            if len(words) <= size or len(known) < need:
                continue
            held = known[in_template[number[known]]]
            starts = np.arange(0, len(words) - size + step, step)
            # Places, not distinct words, are counted here: never too few.
            enough = np.searchsorted(held, starts + size) - np.searchsorted(held, starts) >= need
            for start in starts[enough].tolist():
                yield name, set(words[start : start + size])


def _scanner(phrases: Mapping[str, str], ranks: Mapping[bytes, int], windows: Sequence[tuple], fewest: int, most: int):
    gap, side = rb"[^%s]+" % _LETTERS, (rb"(?<![%s])" % _LETTERS, rb"(?![%s])" % _LETTERS)
    # Looking ahead takes places that overlap, too.
    patterns = [(label, re.compile(side[0] + b"(?=" + gap.join(re.escape(w.encode()) for w in phrase.split()) + side[1] + b")")) for phrase, label in phrases.items()]

    def scan(text: bytes) -> tuple:
        starts = np.flatnonzero(np.diff(_IN_WORD[np.frombuffer(text, np.uint8)].astype(np.int8), prepend=0) == 1)
        places, labels = [], set()
        for label, pattern in patterns:
            at = [m.start() for m in pattern.finditer(text)]
            if at:
                labels.add(label)
                places += np.searchsorted(starts, at).tolist()
        found = set()
        for of, words in _blocks(text, ranks, windows):
            known = words & ranks.keys()
            if len(known) >= fewest and len(words) <= most:
                found.add((of, len(words), tuple(sorted(ranks[w] for w in known))))
        blocks = [{"of": of, "size": size, "ranks": held} for of, size, held in found]
        return len(starts), len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                n, base, first, last, labels, blocks = zip(*(scan(t.lower()) for t in texts))
                yield pa.record_batch({
                    "doc_id": part["doc_id"],
                    "row": part["row"],
                    "n_words": pa.array(n, pa.int64()),
                    "n_base": pa.array(base, pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                    "last_word": pa.array(last, pa.int64()),
                    "base": pa.array(labels, pa.list_(pa.string())),
                    "blocks": pa.array(blocks, pa.list_(pa.struct([("of", pa.string()), ("size", pa.int32()), ("ranks", pa.list_(pa.int32()))]))),
                })

    return run


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, spread: int = SPREAD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, met`` of every row of ``docs`` (``doc_id, text``).

    ``base_labels`` are those of the phrases that stand in the text, ``met`` the templates some block meets, with the best containment.
    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.  Phrases are counted at all places, also where
    places overlap.  No block is left out for its length: what is too long for a template is looked at in windows.

    Null and empty texts have no words, places or labels; repeated rows and null ids are scanned like any row; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    sets = template_sets(templates)
    vocabulary = frozenset(w.encode() for s in sets.values() for w in s)
    counted = docs.select("text").mapInArrow(_counter(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {r.word: r.n for r in counted.collect()}  # one row for each template word
    order = sorted((w.decode() for w in vocabulary), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    listed = []
    for name, words in sets.items():
        ranks, need = sorted(rank[w] for w in words), least_overlap(len(words), containment)
        listed += [(name, len(words), need, ranks, r, i) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    needs = [x[2] for x in listed]
    plan = window_plan(templates, spread, containment)
    windows = [(name, *plan[name], np.isin(np.arange(len(rank)), [rank[w] for w in words])) for name, words in sets.items()]
    most = max([spread * x[1] for x in listed] + [p[0] for p in plan.values()], default=0)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n_words long, n_base long, first_word long, last_word long, "
        "base array<string>, blocks array<struct<of:string,size:int,ranks:array<int>>>"
    )
    fed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    scanned = cut(fed.mapInArrow(_scanner(phrases, {w.encode(): i for w, i in rank.items()}, windows, min(needs, default=1), most), schema))

    index = spark.createDataFrame(listed, "template string, words int, need int, template_ranks array<int>, rank int, place int")
    if sum(len(x[3]) for x in listed) <= BROADCAST_RANKS:
        index = F.broadcast(index)
    block = scanned.select("row", F.explode("blocks").alias("b")).withColumn("held", F.size("b.ranks"))
    # A block's prefix for the smallest overlap any template needs; each template narrows it below.
    prefix = block.select("row", "b", "held", F.posexplode(F.slice("b.ranks", F.lit(1), F.col("held") - min(needs, default=1) + 1)).alias("at", "rank"))
    met = prefix.join(index, "rank")
    left = F.least(F.col("held") - F.col("at"), F.size("template_ranks") - F.col("place"))
    met = met.filter((F.col("held") >= F.col("need")) & (F.col("at") <= F.col("held") - F.col("need")) & (left >= F.col("need")) & (F.col("b.of").isNotNull() | (F.col("b.size") <= spread * F.col("words"))))
    met = met.filter(F.coalesce(F.col("b.of") == F.col("template"), F.lit(True)))
    met = met.withColumn("shared", F.size(F.array_intersect("b.ranks", "template_ranks"))).filter("shared >= need")
    best = met.groupBy("row", "template").agg(F.max(F.col("shared") / F.col("words")).alias("containment"))
    best = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("template", "containment"))).alias("met"))
    none = F.array().cast("array<struct<template:string,containment:double>>")
    return scanned.join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"), F.coalesce("met", none).alias("met")
    )


def _sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    plan = window_plan(TEMPLATES)
    templates = ", ".join(f"('{n}', {w!r}, {least_overlap(len(w))}, {plan[n][0]}, {plan[n][1]})" for n, w in template_sets(TEMPLATES).items())
    return f"""with phrases(p, label) as (values {phrases}), templates(name, t, need, size, step) as (values {templates}),
d as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, doc_id, regexp_extract_all(text, '{word}') as ws from d),
places as (select r, label, i from (select r, ws, p, label, unnest(range(1, len(ws) - len(p) + 2)) as i from w, phrases) where ws[i:i + len(p) - 1] = p),
base as (select r, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, string_agg(distinct label, ',' order by label) as labels, list(distinct label) as l from places group by r),
paragraphs as (select r, unnest(string_split(text, chr(10) || chr(10))) as b from d),
blocks as (select r, b from paragraphs union all select r, unnest(string_split(b, chr(10))) from paragraphs),
long as (select r, regexp_extract_all(b, '{word}') as ws from paragraphs),
windows as (select r, name, ws, size, unnest(range(0, len(ws) - size + step, step)) as i from long, templates where len(ws) > size),
sets as (select r, null as of, list_distinct(regexp_extract_all(b, '{word}')) as s from blocks
    union all select r, name, list_distinct(ws[i + 1:i + size]) from windows),
met as (select r, name, max(len(list_intersect(s, t)) / len(t)) as c from sets, templates
    where (of = name or of is null and len(s) <= {SPREAD} * len(t)) and len(s) >= need and len(list_intersect(s, t)) >= need group by r, name),
best as (select r, list(name) as names, max(c) as c from met group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(labels, '') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(l, []), coalesce(names, [])))), ',') as labels,
    round(case when n_base > 0 then 1.0::double else coalesce(c, 0.0::double) end, 6) as score
from w left join base using (r) left join best using (r)"""


@query("op4_license_scan", _sql())
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's license phrases and the templates its blocks meet."""
    found = scan_licenses(table(spark, sf, "documents"))
    names = F.transform("met", lambda m: m["template"])
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("met", lambda m: m["containment"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", names))), ",").alias("labels"), F.round(score, 6).alias("score"),
    )
