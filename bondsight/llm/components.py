"""Connected components of links, as DataFrames: smallest labels spread over links and along their own chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondsight.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) to (node, root): every node that has a link, and the smallest node it can reach.

    A round takes the smallest label among neighbours and then that label's own label, so chains halve. Each round is
    written to the shared folder, and the one before it deleted.
    """
    links = links.where("a != b")
    spark = links.sparkSession
    both = shared.settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    old = shared.shared_dir(spark)
    labels = shared.settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), old)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("up"))
        path = shared.shared_dir(spark)
        new = shared.settle(new.join(up, "via", "left").select("node", "was", F.least("via", F.coalesce("up", "via")).alias("root")), path)
        shared.forget(spark, old)
        old, labels = path, new.select("node", "root")
        if not new.where("root != was").limit(1).count():
            return labels
