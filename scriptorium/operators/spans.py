"""Half-open intervals by document: islands, gaps and differences, by windows over (doc_id) only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import scanners
from scriptorium.session import ship


def merged(spans: DataFrame) -> DataFrame:
    """spans (doc_id, start, end) with those that overlap or touch made one; empty ones go.

    Equal spans open an island once; the running sum takes them together, so no order among them is relied on.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.filter("start < end").withColumn("opens", F.when(F.col("start") > before, 1).when(before.isNull(), 1).otherwise(0))
    island = opens.withColumn("island", F.sum("opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def gaps(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """What merged spans leave of [0, end) of each document of ends (doc_id, end)."""
    bounds = ends.select("doc_id", F.col("end").alias("start"), F.col("end"))
    rows = merged(spans).unionByName(bounds)
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "end")), F.lit(0))
    return rows.select("doc_id", before.alias("start"), F.col("start").alias("end")).filter("start < end")


def protected(docs: DataFrame) -> DataFrame:
    """doc_id, start, end of what of docs (doc_id, text) isn't to be translated: the scanner's spans without the text inside them.

    Each text is scanned once; only spans reach the sweep. A null text has none.
    """
    ship(docs.sparkSession)
    found = docs.select("doc_id", scanners.guarded_spans("text").alias("g"))
    side = lambda name, k: F.transform(f"g.{name}", lambda x: F.struct(F.lit(k).alias("opened"), x["start"].alias("start"), x["end"].alias("end")))
    tagged = F.concat(side("kept", 0), side("opened", 1))
    rows = found.select("doc_id", F.explode(tagged).alias("s")).select("doc_id", "s.*")
    return subtracted(*(rows.filter(F.col("opened") == k).select("doc_id", "start", "end") for k in (0, 1)))


def subtracted(spans: DataFrame, opened: DataFrame) -> DataFrame:
    """Merged spans without what opened (doc_id, start, end) covers: a sweep over the ends of both, no join."""
    edge = lambda df, name: df.select("doc_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("doc_id", "e.at", F.col("e.step").alias(name))
    edges = edge(merged(spans), "inside").unionByName(edge(merged(opened), "cut"), allowMissingColumns=True)
    steps = edges.groupBy("doc_id", "at").agg(F.sum(F.coalesce("inside", F.lit(0))).alias("inside"), F.sum(F.coalesce("cut", F.lit(0))).alias("cut"))
    order = Window.partitionBy("doc_id").orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select("doc_id", "at", F.lead("at").over(order).alias("end"), F.sum("inside").over(run).alias("inside"), F.sum("cut").over(run).alias("cut"))
    return merged(swept.filter("inside > 0 and cut <= 0 and end is not null").select("doc_id", F.col("at").alias("start"), "end"))
