"""Consistency of translations with a glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import glossary


def _held(segments: DataFrame, translations: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that stand in segments, the translated text, and whether it lacks the term's translation."""
    met = glossary.matches(segments, terms)
    own = [c for c in met.columns if c not in ("source", "translation")]
    lacks = (F.col("translation") != "") & ~F.col("translated").contains(F.col("translation"))
    return met.join(translations, own).withColumn("lacks", lacks)


def missing_terms(segments: DataFrame, translations: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that a segment (doc_id, line or id, text) has and whose translation its translated text (same ids, translated) lacks."""
    return _held(segments, translations, terms).filter("lacks").drop("translated", "lacks")


def counters(segments: DataFrame, translations: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: segments with terms, matched terms, missing terms."""
    met = _held(segments, translations, terms)
    own = [c for c in met.columns if c not in ("source", "translation", "translated", "lacks")]
    return met.agg(F.count_distinct(*own).alias("segments"), F.count("*").alias("matched"), F.count_if("lacks").alias("missing"))


def flagged(segments: DataFrame, translations: DataFrame, terms: DataFrame) -> DataFrame:
    """Segments whose translation lacks a term: their ids, translated, matched_terms and missing_before (source, translation; by source)."""
    met = _held(segments, translations, terms)
    own = [c for c in met.columns if c not in ("source", "translation", "translated", "lacks")]
    term = F.struct("source", "translation")
    listed = lambda c: F.array_sort(F.collect_list(c))
    rows = met.groupBy(*own).agg(F.first("translated").alias("translated"), listed(term).alias("matched_terms"), listed(F.when(F.col("lacks"), term)).alias("missing_before"))
    return rows.filter(F.size("missing_before") > 0)


def still_missing(terms: Column, translated: Column) -> Column:
    """Of an array of terms, those whose translation a text lacks."""
    return F.filter(terms, lambda t: (t["translation"] != "") & ~translated.contains(t["translation"]))


def report(flags: DataFrame, revised: DataFrame) -> DataFrame:
    """flagged() rows with what their revisions (ids, revised, attempts) changed: matched_terms, missing_before, missing_after, changed, review_attempts."""
    own = [c for c in ("doc_id", "line", "id") if c in flags.columns]
    rows = flags.join(revised, own, "left").withColumn("now", F.coalesce("revised", "translated"))
    return rows.select(*own, "matched_terms", "missing_before", still_missing(F.col("matched_terms"), F.col("now")).alias("missing_after"), (F.col("now") != F.col("translated")).alias("changed"), F.coalesce("attempts", F.lit(0)).alias("review_attempts"))
