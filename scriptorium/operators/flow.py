"""The operators composed: from TeX projects to translated, reviewed and checked sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium import functions as fn
from scriptorium.operators import glossary, quality, review, segments
from scriptorium.session import ship
from scriptorium.sources import translation, with_includes

#: Writes what a step made and reads it again, so that models aren't asked twice: (rows, label) to rows.
Keep = Callable[[DataFrame, str], DataFrame]


def as_is(rows: DataFrame, _label: str) -> DataFrame:
    return rows


@dataclass
class Prepared:
    """texts (doc_id, text), nodes (doc_id, node, kind, text, segment_id) and segments (doc_id, id, text) of documents."""

    texts: DataFrame
    nodes: DataFrame
    segments: DataFrame


def prepared(tex: DataFrame, keep: Keep = as_is) -> Prepared:
    """Projects of tex (doc_id, path, content) as one source each, ready for Chinese and by all source rules, and its nodes."""
    ship(tex.sparkSession)
    whole = with_includes(tex)
    return prepared_texts(fn.sanitized(whole.select("doc_id", fn.with_chinese_support(F.col("text")).alias("text"))), keep)


def prepared_texts(texts: DataFrame, keep: Keep = as_is) -> Prepared:
    texts = keep(texts, "texts")
    nodes = keep(segments.numbered(segments.paragraph_nodes(texts)), "nodes")
    return Prepared(texts, nodes, nodes.filter("segment_id is not null").select("doc_id", F.col("segment_id").alias("id"), "text"))


def candidates(rows: DataFrame, most: int = 80) -> DataFrame:
    """doc_id, rank, source, count, kind, contexts: the candidates for a glossary of segments (doc_id, id, text)."""
    lines = glossary.plain(rows.select("doc_id", F.col("id").alias("line"), "text"))
    best = glossary.candidates_in(lines, most)
    return best.join(glossary.contexts(best, lines), ["doc_id", "source"], "left")


def terms(rows: DataFrame, backend: translation.Backend, most: int = 40, requirement: str = "", keep: Keep = as_is) -> DataFrame:
    """The glossary that a model makes of segments' candidates: doc_id, ord, source, translation, type, aliases, note."""
    replies = keep(translation.glossary_replies(candidates(rows), backend, most, requirement), "glossary")
    return glossary.normalized(replies, most)


def translations(rows: DataFrame, known: DataFrame, done: DataFrame | None, backend: translation.Backend, requirement: str = "", limit: int | None = None, keep: Keep = as_is, model: str = "") -> DataFrame:
    """doc_id, id, translation, model, attempts, suspicious, ord: done (the same columns) and what a model makes of the segments that it lacks.

    ``limit`` bounds how many of each document's segments are asked for in this call.
    """
    left = rows if done is None else segments.pending(rows, done)
    if limit is not None:
        from pyspark.sql import Window

        left = left.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))).filter(F.col("turn") <= limit).drop("turn")
    said = glossary.prompt(known).withColumnRenamed("prompt", "terms")
    asked = keep(translation.translated(left.join(said, "doc_id", "left"), backend, requirement, model=model), "translations").withColumn("ord", F.lit(1))
    return asked if done is None else done.unionByName(asked)


def reviewed(rows: DataFrame, made: DataFrame, known: DataFrame, backend: translation.Backend, requirement: str = "", keep: Keep = as_is) -> tuple[DataFrame, DataFrame]:
    """Translations (columns of made, and reviewed_for_consistency) with each document's terms used throughout, and the report's rows."""
    current = segments.latest(made)
    flags = keep(review.flagged(rows, current.select("doc_id", "id", F.col("translation").alias("translated")), known), "flagged")
    better = keep(translation.revised(flags, rows, backend, requirement), "revised")
    out = current.join(better.select("doc_id", "id", "revised"), ["doc_id", "id"], "left")
    out = out.withColumn("reviewed_for_consistency", F.col("revised").isNotNull()).withColumn("translation", F.coalesce("revised", "translation")).drop("revised")
    return out, review.report(flags, better)


@dataclass
class Run:
    """What a run made: the translated sources (doc_id, text, missing, reverted), their issues, the review's rows and a summary by document."""

    sources: DataFrame
    translations: DataFrame
    issues: DataFrame
    review: DataFrame
    summary: DataFrame


def run(tex: DataFrame, backend: translation.Backend, requirement: str = "", passes: int = 2, keep: Keep = as_is) -> Run:
    """All steps over projects. Give a ``keep`` that writes, or each later step asks the model again."""
    ready = prepared(tex, keep)
    known = keep(terms(ready.segments, backend, requirement=requirement, keep=keep), "terms")
    made = translations(ready.segments, known, None, backend, requirement, keep=keep)
    better, rows = reviewed(ready.segments, made, known, backend, requirement, keep)
    better = keep(better, "reviewed")
    final, found = quality.repaired(ready.nodes, better, passes, keep)
    sources = keep(segments.applied(ready.nodes, final), "sources")
    return Run(sources, final, found, rows, summary(ready.segments, final, sources, found))


def summary(rows: DataFrame, made: DataFrame, sources: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, segments, translated, missing, reverted, issues, blocking, status of each document: blocked, incomplete or succeeded."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    parts = [count(rows, "segments"), count(segments.latest(made), "translated"), sources.select("doc_id", F.size("missing").alias("missing"), F.size("reverted").alias("reverted")), count(found, "issues"), count(quality.blocking(found), "blocking")]
    out = sources.select("doc_id")
    for p in parts:
        out = out.join(p, "doc_id", "left")
    out = out.fillna(0)
    return out.withColumn("status", F.when(F.col("blocking") > 0, "blocked").when(F.col("missing") > 0, "incomplete").otherwise("succeeded"))
