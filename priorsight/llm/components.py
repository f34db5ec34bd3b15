"""Connected components of a distributed list of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.plans.lineage import checkpoint_dir, cut, remove, shuffles_removed


#: Links of a task, about; the tables of a loop are as many files.
TASK_LINKS = 250_000


class Steps:
    """The tables of one loop, each written to the shared folder; a table goes as soon as the next step stands.

    A checkpoint would keep the size estimates of the plan it cuts, which multiply with every join of a loop.
    """

    def __init__(self, spark: SparkSession, files: int):
        self.spark, self.files, self.folder, self.paths = spark, files, f"{checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` from a new table of at most ``files`` files."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.coalesce(self.files).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing will read any more."""
        for table in tables:
            if id(table) in self.paths:
                remove(self.spark, self.paths.pop(id(table))[0])

    def clear(self) -> None:
        self.paths.clear()
        remove(self.spark, self.folder)


def _roots(edges: DataFrame, steps: Steps) -> DataFrame:
    """``id, to, moved``: every id points to its smallest neighbour or itself, and pointers are followed to their ends, doubling their length."""
    tree = steps.write(edges.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("to")))
    while True:
        further, before = tree.select(F.col("id").alias("to"), F.col("to").alias("last")), tree
        tree = steps.write(tree.select("id", "to").join(further, "to").select("id", F.col("last").alias("to"), (F.col("last") != F.col("to")).alias("moved")))
        steps.drop(before)
        if tree.filter("moved").isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every end of ``links`` (``a, b``): the smallest id that can be reached.

    In each round, every id that is not the smallest among its neighbours moves to the end of its chain of smallest neighbours, and the links are
    rewritten between those ends; links within one end disappear.  At least half of the ids that still have links move in a round, and
    chains are followed by doubling, so rounds and steps stay logarithmic.  Nothing is collected.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    steps = Steps(links.sparkSession, 8 + both.count() // TASK_LINKS)
    edges, labels = both, None
    while True:
        roots, last = _roots(edges, steps), labels
        if labels is None:
            labels = steps.write(roots.select("id", F.col("to").alias("root")))
        else:
            moved = roots.select(F.col("id").alias("root"), "to")
            labels = steps.write(labels.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        a, b, before = roots.select(F.col("id").alias("a"), F.col("to").alias("na")), roots.select(F.col("id").alias("b"), F.col("to").alias("nb")), edges
        edges = steps.write(edges.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).filter("a <> b").distinct())
        steps.drop(roots, before, last)
        if edges.isEmpty():
            # The result outlives the loop as a checkpoint, which the session's cleaner looks after.
            out = cut(labels)
            steps.clear()
            return out


def extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` (``id, root``, as ``components`` gives it) after more ``links``: only ends of different components go through the loop again."""
    root = lambda end: joined.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    named = links.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = cut(named.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct())
    if apart.isEmpty():
        return joined
    moved = components(apart)
    to = moved.select(F.col("id").alias("root"), F.col("root").alias("to"))
    new = moved.join(joined.select("id"), "id", "left_anti").select("id", "root")
    return cut(joined.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root")).union(new))
