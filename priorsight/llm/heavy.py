"""Contents that hold too many rows for one task: found by counted hashes, confirmed in full, kept out of the shuffle by content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorsight.plans.lineage import cut

#: A hash is heavy if its rows weigh more than this and than the ``1 / HEAVIEST``th part of all, so at most ``HEAVIEST`` hashes are.
HEAVY, HEAVIEST = 1 << 18, 500_000
#: What a row weighs besides its bytes.
ROW = 256
#: Bytes of pivots that are sent to every executor; more are dealt with the rows they are held against.
SENT = 1 << 25


@dataclass
class Parted:
    """``weights``: hash, n, weight of each light hash; ``light``: rows to be compared among themselves; ``heavy``: rows
    (without ``content``) equal to their hash's pivot; ``pivots``: hash, content."""

    weights: DataFrame
    light: DataFrame
    heavy: DataFrame
    pivots: DataFrame
    most: int


def part(rows: DataFrame, heavy: int = HEAVY, sent: int = SENT) -> Parted:
    """``rows`` (``content`` string, not null, and any other columns), each in ``light`` or ``heavy``, both with ``hash``.

    Hashes only choose where a row is compared.  A heavy row is held against the whole content of one row of its hash, the
    pivot; one that differs is light.  So equal contents are all light or all heavy, and no light content weighs more than
    ``most`` unless hashes collide.
    """
    rows = rows.withColumn("hash", F.xxhash64("content"))
    weigh = F.sum(F.octet_length("content").cast("long") + ROW)
    weights = cut(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), weigh.alias("weight")))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    most = max(heavy, total // HEAVIEST)
    # At most HEAVIEST rows of sixteen bytes, by the choice of ``most``.
    many = (F.col("weight") > most) & (F.col("n") > 1)
    chosen = cut(weights.filter(many).select("hash", (F.col("weight") / most + 1).cast("int").alias("lanes")))
    marked = rows.join(F.broadcast(chosen), "hash", "left")
    pivots = cut(marked.filter("lanes is not null").groupBy("hash").agg(F.min("content").alias("content"), F.first("lanes").alias("lanes")))
    size = pivots.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    some = marked.filter("lanes is not null")
    if size <= sent:
        held = some.join(F.broadcast(pivots.select("hash", F.col("content").alias("pivot"))), "hash")
    else:
        spread = pivots.select("hash", F.col("content").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
        others = [f"`{c}`" for c in rows.columns if c not in ("hash", "content")]
        lane = F.pmod(F.xxhash64(*others), F.col("lanes")).cast("int") if others else F.lit(0)
        held = some.withColumn("lane", lane).join(spread, ["hash", "lane"]).drop("lane")
    same = F.col("content") == F.col("pivot")
    differing = held.filter(~same).select(*rows.columns)
    light = marked.filter("lanes is null").select(*rows.columns).union(differing)
    return Parted(
        weights.filter(~many), light, held.filter(same).select(*[c for c in rows.columns if c != "content"]), pivots.select("hash", "content"), most,
    )
