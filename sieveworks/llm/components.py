"""Connected components of an edge table, without gathering vertices or neighbour lists anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every vertex with an edge; label is the smallest id of its component.

    Each round every vertex points to the smallest vertex next to it, two pointer jumps shorten the chains, and the
    edges between different targets go to the next round.  Only minima per vertex are aggregated, so a vertex with a
    third of all edges costs one row per task.
    """
    tables: list[DataFrame] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        tables.append(materialize(df, tag))
        return tables[-1]

    edge = kept(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edge.union(edge.select("b", "a"))
        up = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up")), "up")
        for _ in range(2):
            over = up.select(F.col("id").alias("up"), F.col("up").alias("further"))
            up = up.join(over, "up").select("id", F.col("further").alias("up"))
        up = kept(up, "up")
        if labels is None:
            labels = up.select("id", F.col("up").alias("label"))
        else:
            here = up.select(F.col("id").alias("label"), "up")
            # cut once a round: later rounds must not run earlier ones again
            labels = kept(labels.join(here, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
        left = edge.join(up.select(F.col("id").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("ub")), "b")
        edge = kept(left.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        if edge.isEmpty():
            last = next(t for t in reversed(tables) if "label" in t.columns or "up" in t.columns)  # what labels reads
            tables.remove(last)
            discard(tables)
            return labels
