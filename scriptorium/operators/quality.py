"""Faults of translated texts: one row a fault, reports over them, and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium import functions as fn
from scriptorium import patterns as P
from scriptorium.functions import compact, n_cjk, scanners
from scriptorium.operators import segments as seg
from scriptorium.session import ship

# English words left over in a line of Chinese; sections inside prose; commands that are left out before the words are looked for.
RESIDUE = r"\b(?:and|or|with|as|by|from|to|for|of|in|on)\s+[A-Za-z][A-Za-z-]*|\b(?:Nevertheless|However|Therefore|Overall),?\s+[A-Za-z]|\b(?:Table|Figure|Section)~?\\ref"
SECTION_IN_PROSE = r"\S.{0,120}\\(?:section|subsection|subsubsection)\{"
COMMANDS = r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
# Only texts that match this can have a fault that isn't one of a line.
_SUSPECT = r"[\\`]|\*\*|__|以下为翻译|(?i:Translated LaTeX|Here is the transl)"

#: Code points before and after a fault's place that its snippet has.
REACH = 90
_RULES = [kind for kind, _, _ in P.FAULTS] + ["malformed_reference_key", "latex_section_inside_prose", "english_residue", "missing_list_item", "likely_untranslated_segment"]
_WARNINGS = ("markdown_artifact", "english_residue", "likely_untranslated_segment")
_COLUMNS = ("doc_id", "kind", "severity", "source", "line", "segment_id", "snippet", "suggestion", "place")


def _shaped(found: DataFrame) -> DataFrame:
    """The columns of an issue from doc_id, source, segment_id, kind, at (place within the rule), line and snippet."""
    kind = F.col("kind")
    advice = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in P.ADVICE.items()))
    rule = F.coalesce(*(F.when(kind == k, F.lit(i)) for i, k in enumerate(_RULES)))
    line = F.when(F.col("source").endswith(".tex"), F.col("line"))
    place = F.struct(F.col("segment_id").isNotNull().alias("translated"), F.col("segment_id").alias("segment_id"), rule.alias("rule"), F.col("at").cast("int").alias("at"))
    severity = F.when(kind.isin(*_WARNINGS), "warn").otherwise("error")
    return found.select("doc_id", "kind", severity.alias("severity"), "source", line.cast("int").alias("line"), "segment_id", "snippet", advice.alias("suggestion"), place.alias("place"))


def place_faults(texts: DataFrame) -> DataFrame:
    """Issues that stand at a place of texts (doc_id, text, source, segment_id): patterns, broken keys, lists that open without an item."""
    ship(texts.sparkSession)
    rows = texts.filter(F.col("text").rlike(_SUSPECT)).select("*", F.explode(scanners.faults("text")).alias("f")).select("doc_id", "text", "source", "segment_id", "f.kind", "f.at")
    start = F.greatest(F.col("at") - REACH, F.lit(0))
    snippet = compact(F.substring(F.col("text"), start + 1, F.col("at") + REACH - start))
    line = F.length(F.regexp_replace(F.substring(F.col("text"), F.lit(1), F.col("at")), "[^\n]+", "")) + 1
    return _shaped(rows.select("doc_id", "source", "segment_id", "kind", "at", line.alias("line"), snippet.alias("snippet")))


def line_faults(texts: DataFrame) -> DataFrame:
    """Issues of single lines: sections inside prose, and English left in lines of eight CJK characters or more."""
    lines = texts.select("doc_id", "source", "segment_id", F.posexplode(F.split("text", fn.LINE_END)).alias("at", "text"))
    prose = F.regexp_replace("text", COMMANDS, " ")
    residue = (n_cjk(F.col("text")) >= 8) & (prose.rlike(RESIDUE) | F.col("text").rlike(r"\b(?:Table|Figure|Section)~?\\ref"))
    section = F.col("text").contains("section{") & F.col("text").rlike(SECTION_IN_PROSE)  # most lines end at the first test
    found = F.array_compact(F.array(F.when(section, F.lit("latex_section_inside_prose")), F.when(residue, F.lit("english_residue"))))
    rows = lines.select("*", F.explode(found).alias("kind"))
    return _shaped(rows.select("doc_id", "source", "segment_id", "kind", "at", (F.col("at") + 1).alias("line"), compact(F.col("text")).alias("snippet")))


def issues(texts: DataFrame, source: str = "translated.tex") -> DataFrame:
    """Issues of texts (doc_id, text; source and segment_id may be there): doc_id, kind, severity, source, line, segment_id, snippet, suggestion, place.

    Only sources that end in .tex give lines; place orders a document's issues. A null text has none.
    """
    for name, value in (("source", F.lit(source)), ("segment_id", F.lit(None).cast("string"))):
        if name not in texts.columns:
            texts = texts.withColumn(name, value)
    return place_faults(texts).unionByName(line_faults(texts))


def live(tex: DataFrame, translations: DataFrame) -> DataFrame:
    """translations (doc_id, id, translation) whose beginning still stands in their document's text (doc_id, text), or is too short to tell.

    A document's text meets its translations once, not once for each.
    """
    whole = tex.groupBy("doc_id").agg(F.max(compact(F.col("text"))).alias("whole"))
    held = translations.groupBy("doc_id").agg(F.collect_list(F.struct("id", "translation")).alias("held"))
    probe = lambda t: F.substring(compact(t["translation"]), 1, 120)
    stands = lambda t: F.coalesce((F.length(probe(t)) < 24) | (F.col("whole") == "") | F.col("whole").contains(probe(t)), F.lit(True))
    return held.join(whole, "doc_id", "left").select("doc_id", F.explode(F.filter("held", stands)).alias("t")).select("doc_id", "t.*")


def report(tex: DataFrame, segments: DataFrame, translations: DataFrame, tex_name: str = "translated.tex", rows_name: str = "translations.jsonl") -> DataFrame:
    """Issues of documents' translated texts (doc_id, text) and of the translations (doc_id, id, translation) that they still have.

    segments (doc_id, id, text) are the originals, to which translations that look untranslated are held.
    """
    held = live(tex, translations)
    texts = held.select("doc_id", F.col("translation").alias("text"), F.lit(rows_name).alias("source"), F.col("id").alias("segment_id")).filter("text != '' and segment_id != ''")
    both = held.join(segments.select("doc_id", "id", F.col("text").alias("original")), ["doc_id", "id"]).filter("original != ''")
    left = both.filter(fn.untranslated(F.col("original"), F.coalesce("translation", F.lit(""))))
    english = left.select("doc_id", F.lit(rows_name).alias("source"), F.col("id").alias("segment_id"), F.lit("likely_untranslated_segment").alias("kind"), F.lit(-1).alias("at"), F.lit(None).alias("line"), compact(F.substring("translation", 1, 220)).alias("snippet"))
    return issues(tex.select("doc_id", "text"), tex_name).unionByName(issues(texts)).unionByName(_shaped(english))


def blocking(found: DataFrame) -> DataFrame:
    return found.filter((F.col("severity") == "error") | F.col("kind").isin(*P.BLOCKING))


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity and kind, with subtotals."""
    return found.rollup("severity", "kind").agg(F.count("*").alias("n"))


def report_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, report: the list of each document's issues as Markdown, for all of docs (doc_id)."""
    where = F.array_join(F.array_compact(F.array(F.concat(F.lit("line "), F.col("line").cast("string")), "segment_id")), ", ")
    said = F.concat(F.lit("**"), "severity", F.lit(" / "), "kind", F.lit("**"), F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""))
    entry = F.concat(said, F.lit("\n   - Snippet: `"), "snippet", F.lit("`\n   - Action: "), "suggestion")
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", entry.alias("entry")))).alias("all"))
    rows = docs.select("doc_id").distinct().join(listed, "doc_id", "left")
    count = F.coalesce(F.size("all"), F.lit(0))
    lines = F.array_join(F.transform("all", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["entry"])), "\n")
    head = F.concat(F.lit(f"{P.REPORT_TITLE}\n\n- Issue count: "), F.greatest(count, F.lit(0)).cast("string"), F.lit("\n\n"))
    return rows.select("doc_id", F.concat(head, F.coalesce(lines, F.lit(P.REPORT_CLEAN)), F.lit("\n")).alias("report"))


def payload(found: DataFrame) -> DataFrame:
    """doc_id, payload: each document's issues as a JSON object with their count."""
    one = F.struct(*(c for c in _COLUMNS if c not in ("doc_id", "place")))
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("issue")))).alias("all"))
    return listed.select("doc_id", F.to_json(F.struct(F.size("all").alias("issue_count"), F.transform("all", lambda x: x["issue"]).alias("issues"))).alias("payload"))


def loaded(payloads: DataFrame) -> DataFrame:
    """Issues from payloads (doc_id, payload); what isn't such an object gives none."""
    one = "kind string, severity string, source string, line int, segment_id string, snippet string, suggestion string"
    return payloads.select("doc_id", F.explode(F.from_json("payload", f"issues array<struct<{one.replace(' ', ':').replace(',:', ',')}>>")["issues"]).alias("i")).select("doc_id", "i.*")


def repaired(nodes: DataFrame, translations: DataFrame, passes: int = 2, keep=lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """translations (doc_id, id, translation, ord) and their report's issues after at most ``passes`` repairs of documents that have blocking issues.

    ``keep`` (a DataFrame and a label to a DataFrame) should write what a pass made and read it again; without it each pass computes
    all before it once more. Ends where a pass changes nothing.
    """
    originals = nodes.filter("segment_id is not null").select("doc_id", F.col("segment_id").alias("id"), "text")
    for turn in range(passes + 1):
        found = keep(report(seg.applied(nodes, translations), originals, translations), f"issues{turn}")
        blocked = blocking(found).select("doc_id").distinct()
        if turn == passes or blocked.isEmpty():
            break
        bad = seg.repaired(originals, translations.join(blocked, "doc_id", "left_semi"))
        bad = keep(bad, f"repaired{turn}")
        if bad.filter("changed").isEmpty():
            break
        translations = translations.join(blocked, "doc_id", "left_anti").unionByName(bad.drop("changed").select(*translations.columns))
    return translations, found


def critical_log_lines(logs: DataFrame) -> DataFrame:
    """Lines (doc_id, line) of compiler logs (doc_id, log) that mean failure."""
    return logs.select("doc_id", F.explode(F.split("log", "\n")).alias("line")).filter(F.col("line").rlike(P.CRITICAL_LOG)).select("doc_id", F.trim("line").alias("line"))
