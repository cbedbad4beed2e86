"""Documents as ordered nodes of prose and layout, their numbering, and rebuilding with translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import functions as fn
from scriptorium.functions import scanners
from scriptorium.session import ship

#: Code points that a segment is meant to have at most; a single sentence may be longer.
MOST = 5000
_GAP = r"(?U)\n\s*\n+"


def sentence_chunks(text: Column, most: int = MOST) -> Column:
    """Runs of whole sentences of at most ``most`` code points; joined they are the text again. A longer sentence stays whole."""
    end = "(?<=[.?!;:。！？；：])"
    # Each sentence with the blanks before it as pieces of their own, as either may open a chunk.
    parts = F.flatten(F.transform(fn.with_gaps(text, rf"(?U){end}\s+"), lambda p: F.array(p["part"], p["gap"])))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(x) > most) & (fn.strip(acc["open"]) != "") & (x != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, x).otherwise(F.concat(acc["open"], x)).alias("open"))

    greedy = F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.length(text) > most, greedy).otherwise(F.array(text))


def paragraph_nodes(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, node, kind, text of docs (doc_id, text): segments worth translating and all else, in order; joined they are the text again.

    Text between protected spans is cut at blank lines, and paragraphs of over ``most`` code points between sentences. White space
    around paragraphs belongs to the layout. Neighbours to preserve are one node (islands over one window by document). A null or empty
    text has no nodes; rows of equal doc_id are one document's, in no fixed order.
    """
    ship(docs.sparkSession)
    raw = docs.select("doc_id", F.posexplode(scanners.text_pieces("text")).alias("at", "p")).select("doc_id", "at", "p.kind", "p.text")
    raw = raw.withColumn("prose", (F.col("kind") == "translate") & fn.should_translate(F.col("text")))
    cut = F.flatten(F.transform(fn.with_gaps(F.col("text"), _GAP), lambda p: F.array(p["part"], p["gap"])))
    parts = raw.select("doc_id", "at", "prose", F.posexplode(F.when(F.col("prose"), cut).otherwise(F.array("text"))).alias("part", "text")).filter("text != ''")
    core = fn.strip(F.col("text"))
    parts = parts.withColumn("core", core).withColumn("lead", F.regexp_extract("text", r"(?U)\A(\s*)", 1)).withColumn("prose", F.col("prose") & fn.should_translate(F.col("core")))
    chunks = F.concat(F.array("lead"), sentence_chunks(F.col("core"), most), F.array(F.substring(F.col("text"), F.length("lead") + F.length("core") + 1, F.length("text"))))
    rows = parts.select("doc_id", "at", "part", "prose", "core", F.posexplode(F.when(F.col("prose"), chunks).otherwise(F.array("text"))).alias("chunk", "text")).filter("text != ''")
    rows = rows.withColumn("kind", F.when(F.col("prose") & ((F.col("text") == F.col("core")) | fn.should_translate(F.col("text"))), "translate").otherwise("preserve"))
    order = Window.partitionBy("doc_id").orderBy("at", "part", "chunk")
    opens = F.when((F.col("kind") == "translate") | (F.coalesce(F.lag("kind").over(order), F.lit("translate")) == "translate"), 1).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumn("node", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "chunk", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("doc_id", "node", "kind").agg(text.alias("text"))


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with segment_id seg-0001, seg-0002, ... for those to translate."""
    turn = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("node"))
    return nodes.withColumn("segment_id", F.when(F.col("kind") == "translate", F.format_string("seg-%04d", turn)))


def latest(translations: DataFrame) -> DataFrame:
    """The last row (by ord) of each doc_id and id."""
    turn = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("ord")))
    return translations.withColumn("turn", turn).filter("turn = 1").drop("turn")


def pending(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments without a translation that isn't empty."""
    return segments.join(translations.filter("translation is not null and translation != ''"), ["doc_id", "id"], "left_anti")


def rebuilt(nodes: DataFrame, translations: DataFrame) -> DataFrame:
    """doc_id, text with repaired translations in their nodes' places, and the ids of segments that are missing or reverted.

    A segment without a translation (no row, or null) keeps its text and is missing; an empty translation counts. A translation
    that can't be repaired gives way to the original and is reverted.
    """
    ship(nodes.sparkSession)
    got = latest(translations).select("doc_id", F.col("id").alias("segment_id"), "translation")
    rows = nodes.join(got, ["doc_id", "segment_id"], "left")
    repaired = F.when(F.col("kind") == "translate", scanners.fixed(F.coalesce("translation", "text"), "text")).otherwise(F.col("text"))
    rows = rows.withColumn("out", repaired)
    missing = F.col("segment_id").isNotNull() & F.col("translation").isNull()
    reverted = (F.col("out") == F.col("text")) & (F.col("translation") != F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "out"))), lambda x: x["out"]), "")
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("segment_id"))))
    return rows.groupBy("doc_id").agg(text.alias("text"), ids(missing).alias("missing"), ids(reverted).alias("reverted"))


def applied(nodes: DataFrame, translations: DataFrame) -> DataFrame:
    """rebuilt(), its text with front matter by rule and all source rules: the translated source of each document."""
    out = rebuilt(nodes, translations)
    out = out.withColumn("text", fn.front_matter_texts(F.col("text"))).withColumn("text", fn.front_matter_layout(F.col("text")))
    return fn.sanitized(out)


def repaired(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """translations (doc_id, id, translation) as their segments' text (doc_id, id, text) allows, with changed; those without a segment stay."""
    ship(segments.sparkSession)
    texts = segments.select("doc_id", "id", F.col("text").alias("original"))
    fixed = F.when((F.col("original") != "") & (F.col("translation") != ""), scanners.fixed("translation", "original"))
    out = translations.join(texts, ["doc_id", "id"], "left").withColumn("fixed", F.coalesce(fixed, "translation"))
    return out.withColumn("changed", F.coalesce(F.col("fixed") != F.col("translation"), F.lit(False))).withColumn("translation", F.col("fixed")).drop("original", "fixed")
