"""Connected components of a link table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, unique_join


def _roots(near: DataFrame) -> DataFrame:
    """(v, p) with each pointer followed to its end; pointers lead to smaller nodes or to the node itself.

    Each step doubles how far a pointer leads, so that a path of n nodes takes log n of them.
    """
    while True:
        step = unique_join(near, near.select(F.col("v").alias("p"), F.col("p").alias("q")), ["p"], 32)
        far = materialize(step.select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "far")
        near = far.select("v", "p")
        if far.where("moved").isEmpty():
            return near


def components(links: DataFrame) -> DataFrame:
    """(v, label): for each end of a link (a, b) the smallest node of its component.

    Each round points every node at its smallest neighbour or itself, follows the pointers to
    their ends and replaces the links by those between what they end at; links that have met
    vanish. Whoever isn't the smallest around moves, so that a round leaves half of the linked
    nodes at most, also of an ordered chain. A node that a third of all links meet at is joined by
    broadcast (``unique_join``). Rounds are cut from their lineage in the shared folder. Nodes of
    no link are not returned; an empty table gives an empty result.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v"))
    first = True
    while not links.isEmpty():
        near = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("p"))
        near = near.groupBy(F.col("p.v").alias("v")).agg(F.min("p.u").alias("u")).select("v", F.least("v", "u").alias("p"))
        ends = _roots(materialize(near, "near"))
        if first:
            labels, first = ends.withColumnRenamed("p", "label"), False
        else:  # labels that no link meets any more stay as they are
            done = ends.select(F.col("v").alias("label"), F.col("p").alias("q"))
            labels = unique_join(labels, done, ["label"], 32, how="left").select("v", F.coalesce("q", "label").alias("label"))
            labels = materialize(labels, "labels")
        links = unique_join(links, ends.select(F.col("v").alias("a"), F.col("p").alias("qa")), ["a"], 32).select("qa", "b")
        links = unique_join(materialize(links, "links"), ends.select(F.col("v").alias("b"), F.col("p").alias("qb")), ["b"], 32)
        links = links.where("qa <> qb").select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b")).distinct()
        links = materialize(links, "links")
    return labels
