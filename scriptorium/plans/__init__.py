"""Registered queries of the engine and the SQL they are held against.

The tables hold no LaTeX and no Chinese, so queries that need either make it from them, in the same way in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import functions as fn
from scriptorium import patterns as P
from scriptorium import sources
from scriptorium.functions import scanners
from scriptorium.operators import glossary, quality, review, segments, spans
from scriptorium.session import ship
from scriptorium.sources import translation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "glossary_candidates"


def query(sql: str | None = None):
    """Register a function as the query of its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, dealt over the cores if they come in fewer parts; large inputs come in more, and are not dealt."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- glossary ---

_TOKENS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
toks AS (SELECT doc_id, regexp_extract_all(t, '{P.WORD}') AS w FROM lines),
low AS (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS w FROM toks),
sized AS (SELECT doc_id, w, unnest([2, 3, 4]) AS n FROM low),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i : i + n - 1])) AS g FROM sized WHERE len(w) >= n),
named AS (SELECT doc_id, g[1] AS a, g[-1] AS z, list_aggregate(list_transform(g, lambda x: length(x)), 'max') AS longest, array_to_string(g, ' ') AS source FROM grams),
ngrams AS (SELECT doc_id, source, count(*) AS count FROM named WHERE a NOT IN ({quoted(P.STOPWORDS)}) AND z NOT IN ({quoted(P.STOPWORDS)})
  AND longest >= 4 AND length(source) BETWEEN 6 AND 48 AND source NOT IN ({quoted(P.GENERIC_PHRASES)}) GROUP BY doc_id, source)"""
# Letters beyond ASCII count as parts of words: one stands for each, as this engine's word boundary knows ASCII only.
_ACRONYMS = f"""caps AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ɏ]', 'x', 'g'), '\\b[A-Z][A-Z0-9-]{{1,14}}\\b')) AS source FROM documents),
acronyms AS (SELECT doc_id, source, count(*) AS count FROM caps WHERE lower(source) NOT IN ({quoted(P.STOPWORDS)}) GROUP BY doc_id, source)"""


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.plain(glossary.lines_of(documents(spark, sf_dir)))


@query(f"WITH {_TOKENS} SELECT doc_id, source, count FROM ngrams WHERE count >= 2")
def glossary_ngrams(spark, sf_dir):
    return glossary.ngrams(plain_lines(spark, sf_dir)).filter(F.col("count") >= 2)


@query(f"WITH {_ACRONYMS} SELECT doc_id, source, count FROM acronyms")
def glossary_acronyms(spark, sf_dir):
    return glossary.acronyms(plain_lines(spark, sf_dir))


@query(f"""WITH {_TOKENS}, {_ACRONYMS},
both_kinds AS (SELECT doc_id, source, count, 'term' AS kind FROM ngrams UNION ALL SELECT doc_id, source, count, 'abbreviation' AS kind FROM acronyms),
ranked AS (SELECT doc_id, source, count, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count * CASE WHEN kind = 'abbreviation' THEN 3 ELSE 1 END DESC,
  count DESC, len(string_split(source, ' ')) DESC, source DESC, kind) AS INTEGER) AS rank FROM both_kinds WHERE count >= 2)
SELECT doc_id, rank, source, count, kind FROM ranked WHERE rank <= 80""")
def glossary_candidates(spark, sf_dir):
    return glossary.candidates(documents(spark, sf_dir))


@query()
def glossary_contexts(spark, sf_dir):
    """Held against brute force in the tests: SQL has no places of matches."""
    lines = plain_lines(spark, sf_dir)
    return glossary.contexts(glossary.candidates_in(lines), lines).select("doc_id", "source", F.array_join("contexts", "\n").alias("contexts"))


# Terms of the benchmark: the first two words of each item, and a translation made from its number.
_TERMS = "terms AS (SELECT DISTINCT lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], ' ')) AS source, '译' || CAST(min(item_id) AS VARCHAR) AS translation FROM benchmark GROUP BY 1)"


def benchmark_terms(spark, sf_dir):
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2)
    return table(spark, sf_dir, "benchmark").groupBy(F.lower(F.array_join(words, " ")).alias("source")).agg(F.concat(F.lit("译"), F.min("item_id").cast("string")).alias("translation"))


_MATCHES = f"""{_TERMS}, segs AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line FROM documents),
matched AS (SELECT doc_id, line, source, translation FROM segs, terms WHERE regexp_matches(t, '(?i)(^|[^A-Za-z0-9])' || replace(source, ' ', '\\s+') || '([^A-Za-z0-9]|$)'))"""


@query(f"WITH {_MATCHES} SELECT DISTINCT doc_id, line, source, translation FROM matched")
def segment_term_matches(spark, sf_dir):
    return glossary.matches(glossary.lines_of(documents(spark, sf_dir)), benchmark_terms(spark, sf_dir))


def half_translated(spark, sf_dir):
    """Lines whose translation holds the terms of even-numbered lines only."""
    lines = glossary.lines_of(documents(spark, sf_dir))
    terms = glossary.matches(lines, benchmark_terms(spark, sf_dir)).filter("line % 2 = 0").groupBy("doc_id", "line").agg(F.array_join(F.array_sort(F.collect_set("translation")), " ").alias("translated"))
    return lines.select("doc_id", "line").join(terms, ["doc_id", "line"], "left").fillna("", ["translated"])


_HALF = "SELECT DISTINCT doc_id, line, source, translation, line % 2 = 1 AND len(list_filter(translations, lambda x: contains(x, translation))) = 0 AS lacks FROM (SELECT *, [''] AS translations FROM matched)"


@query(f"WITH {_MATCHES}, judged AS ({_HALF}) SELECT doc_id, line, source, translation FROM judged WHERE lacks")
def missing_terms(spark, sf_dir):
    return review.missing_terms(glossary.lines_of(documents(spark, sf_dir)), half_translated(spark, sf_dir), benchmark_terms(spark, sf_dir))


@query(f"WITH {_MATCHES}, judged AS ({_HALF}) SELECT count(DISTINCT (doc_id, line)) AS segments, count(*) AS matched, count(*) FILTER (WHERE lacks) AS missing FROM judged")
def consistency_counters(spark, sf_dir):
    return review.counters(glossary.lines_of(documents(spark, sf_dir)), half_translated(spark, sf_dir), benchmark_terms(spark, sf_dir))


_NORMALIZED = """asked AS (SELECT item_id % 4 AS doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
listed AS (SELECT doc_id, w[1] AS source, upper(w[2]) AS translation, w[3:11] AS aliases, row_number() OVER (PARTITION BY doc_id ORDER BY w[1], upper(w[2]), w[3:11]) AS i FROM asked WHERE len(w) > 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(source) ORDER BY i) AS n FROM listed),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ord FROM firsts WHERE n = 1)"""


def replies(spark, sf_dir):
    """Replies of a model, as JSON with stray white space: the words of each benchmark item as a term with nine aliases."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    one = F.struct(F.element_at(words, 1).alias("source"), F.upper(F.element_at(words, 2)).alias("translation"), F.slice(words, 3, 9).alias("aliases"))
    rows = table(spark, sf_dir, "benchmark").filter(F.size(words) > 3).groupBy((F.col("item_id") % 4).alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("terms"))
    spaced = F.transform("terms", lambda t: F.struct(F.concat(F.lit(" "), t["source"], F.lit("\n")).alias("source"), t["translation"].alias("translation"), t["aliases"].alias("aliases")))
    return rows.select("doc_id", F.to_json(F.struct(spaced.alias("terms"))).alias("reply"))


@query(f"WITH {_NORMALIZED} SELECT doc_id, ord, source, translation, 'term' AS type, array_to_string(aliases[1:6], '|') AS aliases, '' AS note FROM kept WHERE ord <= 40")
def terms_normalized(spark, sf_dir):
    return glossary.normalized(replies(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""WITH {_NORMALIZED} SELECT doc_id, '{glossary.PROMPT_HEAD}' || chr(10) || string_agg('- ' || source || ' -> ' || translation || ' | aliases: ' || array_to_string(aliases[1:3], ', '), chr(10) ORDER BY ord) AS prompt
FROM kept WHERE ord <= 30 GROUP BY doc_id""")
def glossary_prompt(spark, sf_dir):
    return glossary.prompt(glossary.normalized(replies(spark, sf_dir)), 30)


# --- scalar rules ---

_TEXDOC = r"""tex AS (SELECT doc_id, '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || '\section{Doc ' || CAST(doc_id AS VARCHAR) || '}' || chr(10)
|| replace(text, chr(10), chr(10) || chr(10)) || ' see~\cite{ref\_' || CAST(doc_id AS VARCHAR) || '} and $x_' || CAST(doc_id AS VARCHAR) || '$ % note' || chr(10) || '\end{document}' AS tex FROM documents)"""


def texdoc(spark, sf_dir):
    """Each document as an article: preamble, a heading, paragraphs, a citation, a formula and a comment."""
    i, text = F.col("doc_id").cast("string"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    head = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\section{Doc "), i, F.lit("}\n"))
    return documents(spark, sf_dir).select("doc_id", F.concat(head, text, F.lit(" see~\\cite{ref\\_"), i, F.lit("} and $x_"), i, F.lit("$ % note\n\\end{document}")).alias("text"))


def _rewrite_query(name: str, rule: str, prefix: str, suffix: str, sql: str) -> None:
    """A query that puts each text between prefix and suffix and applies a rule; sql is the rule over column t."""

    def run(spark, sf_dir):
        docs = documents(spark, sf_dir)
        return docs.select("doc_id", fn.rewrite(F.concat(F.lit(prefix), "text", F.lit(suffix)), rule).alias("text"))

    run.__name__ = name
    lit = lambda s: " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))
    query(f"SELECT doc_id, {sql} AS text FROM (SELECT doc_id, {lit(prefix)} || text || {lit(suffix)} AS t FROM documents)")(run)


_rewrite_query("cjk_punct", "cjk_punctuation", r"a\（b\）", r" c\。", r"regexp_replace(t, '\\([（）【】《》，。；：、])', '\1', 'g')")
_rewrite_query("double_escaped_refs", "double_escaped_references", r"\\ref{a} ", r" \\citep{b} \\textbf{c}", r"regexp_replace(t, '\\\\(Cref|cref|ref|eqref|pageref|nameref|cite|citep|citet|citealp|citealt|citeauthor|citeyear)\{', '\\\1{', 'g')")
_rewrite_query("section_ref_phrase", "section_phrases", r"见\S所示。\ref{s1} ", r" \S所示\ref{s2}", r"regexp_replace(t, '\\S所示[。.]?\s*\\ref\{([^}]+)\}', '\\S\\ref{\1}所示', 'g')")
_rewrite_query("caption_prefix", "caption_prefixes", "Figure 12 | x\n", "\nTable 3| y", r"regexp_replace(regexp_replace(t, '(?m)^Figure\s+(\d+)\s*\|', '图\1 |', 'g'), '(?m)^Table\s+(\d+)\s*\|', '表\1 |', 'g')")
_rewrite_query("ref_brackets", "reference_brackets", "[1] A\n", "\n [23] B [4]", r"regexp_replace(t, '(?m)^(\s*)\[(\d{1,3})\]', '\1{[}\2{]}', 'g')")
_rewrite_query("math_font", "math_fonts", r"$\mathbf{\bar{x}}$ ", r" $\mathbf { \hat { y } }$", r"regexp_replace(t, '\\mathbf\s*\{\s*(\\(?:bar|hat|tilde|vec|dot|ddot)\s*\{\s*[^{}]+?\s*\})\s*\}', '\1', 'g')")
_rewrite_query("control_word_boundary", "control_word_boundaries", r"\method中 ", r" \alpha文", r"regexp_replace(t, '\\([A-Za-z@]+)([一-鿿])', '\\\1{}\2', 'g')")
_rewrite_query("text_symbols", "text_symbols", r"\textless x ", r" \textgreater{} \textbar", r"regexp_replace(regexp_replace(t, '\\(textless|textgreater|textbar)\{\}', '\\\1', 'g'), '\\(textless|textgreater|textbar)', '\\\1{}', 'g')")
_rewrite_query("linebreak_dims", "linebreak_dimensions", "a \\[2pt] ", " b \\[ 1.5em ]", r"regexp_replace(t, '([^\\])\\\[(\s*\d+(?:\.\d+)?(?:pt|em|ex|mm|cm|in)\s*)\]', '\1\\\\[\2]', 'g')")
_rewrite_query("item_syntax", "item_space", r"\item中 \itemsep1 ", r" \item[x]", r"regexp_replace(t, '\\item([^A-Za-z@\s])', '\\item \1', 'g')")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def compact_ws(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", fn.compact(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\*\*([^\n*][^\n]*?[^\n*])\*\*', '\1', 'g') AS text FROM documents")
def markdown_artifacts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", fn.rewrite(F.col("text"), "markdown_emphasis").alias("text"))


#: A text's junk after the rules for emphasis and for names between bars.
_TIDY = r"regexp_replace(regexp_replace(text, '\*\*([^\n*][^\n]*?[^\n*])\*\*', '\1', 'g'), '\|\s*(/?.{1,4}?)\s*\|', '|\1|', 'g')"


def _quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in text.split("\n"))


_SOURCE = """\\documentclass{article}
  \\pdfoutput=1 % for the archive
\\usepackage[b]{xcolor}
\\usepackage{ucharclasses}
\\begin{document}
→ ⼀｜ \\cite{ref\\_1,ref\\_2} a_b $x_7$ \\method中 \\textbar x \\（甲\\） |参考| \\mathbf{\\hat{y}}

Figure 3 | caption

\\begin{itemize}
文
\\end{itemize}
\\item中 [12] \\begin{figure}f_g\\end{figure}
\\pandocbounded{\\includegraphics{x}}
Figure 1 an image

"""
_SANITIZED = """\\documentclass{article}

\\usepackage[b]{xcolor}
\\begin{document}
\\ensuremath{\\rightarrow} 一| \\cite{ref_1,ref_2} a\\_b $x_7$ \\method{}中 \\textbar{} x （甲） |ref| \\hat{y}

图3 | caption

\\begin{itemize}
\\item 文
\\end{itemize}
\\item {}中 [12] \\begin{figure}f_g\\end{figure}
\\begin{figure}[tbp]
\\centering
\\pandocbounded{\\includegraphics{x}}
Figure 1 an image
\\end{figure}

"""


@query(rf"SELECT doc_id, {_quoted(_SANITIZED)} || {_TIDY} || chr(10) || '\end{{document}}' AS text FROM documents")
def sanitized(spark, sf_dir):
    """All source rules over a source that breaks most of them, with the document as its body."""
    return fn.sanitized(documents(spark, sf_dir).select("doc_id", F.concat(F.lit(_SOURCE), "text", F.lit("\n\\end{document}")).alias("text")))


@query(r"SELECT doc_id, regexp_replace('\begin{itemize}' || chr(10) || text || chr(10) || '\end{itemize}', '^(\\begin\{itemize\}\s*)([^\s\\])', '\1\\item \2') AS text FROM documents")
def missing_items(spark, sf_dir):
    wrapped = F.concat(F.lit("\\begin{itemize}\n"), "text", F.lit("\n\\end{itemize}"))
    return documents(spark, sf_dir).select("doc_id", fn.rewrite(wrapped, "missing_list_items").alias("text"))


@query(r"SELECT doc_id, '\documentclass{article}' || chr(10) || chr(10) || '\usepackage[table,dvipsnames,svgnames]{xcolor}' || chr(10) || text AS text FROM documents")
def xcolor_merged(spark, sf_dir):
    both = F.concat(F.lit("\\usepackage[table,dvipsnames]{xcolor}\n\\documentclass{article}\n\\usepackage[table, svgnames]{xcolor}\n"), "text")
    return documents(spark, sf_dir).select("doc_id", fn.merged_xcolor(both).alias("text"))


def _placed_query(name: str, build, before: str, after: str, made_before: str, made_after: str) -> None:
    """A query that puts each text between before and after; SQL says what build makes of both ends."""

    def run(spark, sf_dir):
        ship(spark)
        return documents(spark, sf_dir).select("doc_id", build(F.concat(F.lit(before), "text", F.lit(after))).alias("text"))

    run.__name__ = name
    query(f"SELECT doc_id, {_quoted(made_before)} || text || {_quoted(made_after)} AS text FROM documents")(run)


_placed_query("problem_unicode", fn.normal_characters, "→ ⇐\x07 ⼀⻅｜ ", " ⽔\x85\x1f ←⇒", r"\ensuremath{\rightarrow} \ensuremath{\Leftarrow} 一见| ", r" 水 \ensuremath{\leftarrow}\ensuremath{\Rightarrow}")
_placed_query("reference_keys", lambda c: fn.rewrite(c, "reference_keys"), r"\cite[p.\_1]{a\_b,c\_\_d} x\_y ", r" \ref*{s\_1} \textbf{t\_u} \label{open\_", r"\cite[p.\_1]{a_b,c__d} x\_y ", r" \ref*{s_1} \textbf{t\_u} \label{open\_")
_placed_query("pdf_output", lambda c: fn.rewrite(c, "pdf_output"), "\\x\n \\pdfoutput = 1 % a\n", "\n\\pdfoutput=1", "\\x\n", "\n\\pdfoutput=1")
_placed_query("jobname_probe", lambda c: fn.rewrite(c, "jobname_probe"), "{\\catcode/=0 \\catcode\\\\=12/gdef/mkillslash\\#1{#1}}\n\\edef\\jobnametmp{\\expandafter\\string\\csname job_apx \\endcsname}\n\\edef\\jobnameapx{\\expandafter\\mkillslash\\jobnametmp}\n", "", "\\edef\\jobnameapx{job_apx}\n", "")
_placed_query("reference_headings", fn.reference_heading, "", "\nReferences \n\n{[}1{]} First\n{[}2{]} Second", "", "\n\n\\section*{参考文献}\n\n{[}1{]} First\n{[}2{]} Second")
_placed_query("font_fallback", scanners.without_font_fallback, "\\IfFontExistsTF{Source Han Serif CN} {a{b}}\n{c\\}}", " \\IfFontExistsTF{Source Han Serif CN}{d}", "% CJK font fallback is handled by ctex", " \\IfFontExistsTF{Source Han Serif CN}{d}")
_placed_query("longtable_groups", fn.closed_longtables, "{\\def\\LTcaptype{none}\\begin{longtable}a\\end{longtable}", "\\end{longtable}  }", "{\\def\\LTcaptype{none}\\begin{longtable}a\\end{longtable}\n}", "\\end{longtable}  }")
_placed_query("figure_blocks", scanners.wrapped_figures, "a\n\\pandocbounded{\\includegraphics{1}}\n\\pandocbounded{\\includegraphics{2}}\n图 2\nmore\n\n", "\n\\pandocbounded{\\includegraphics{3}}\nrest", "a\n\\begin{figure}[tbp]\n\\centering\n\\pandocbounded{\\includegraphics{1}}\n\\pandocbounded{\\includegraphics{2}}\n图 2\nmore\n\\end{figure}\n\n", "\n\\pandocbounded{\\includegraphics{3}}\nrest")
_placed_query("chinese_support", fn.with_chinese_support, "\\documentclass[a]{b}\n", "\\url{x}", "\\documentclass[a]{b}\n\\usepackage{url}\n\\usepackage[UTF8]{ctex}\n", "\\url{x}")
_placed_query("front_matter_texts", fn.front_matter_texts, "*: Core contributors ‡: Project lead ", "*: Core contributors  ‡: Project lead", "*: 核心贡献者 ‡: 项目负责人 ", "*: 核心贡献者 ‡: 项目负责人")
_placed_query("front_matter_layout", fn.front_matter_layout, "p\\begin{document}\n\\section*{My  T}\nA B\n\nC D\n\\section*{摘要}\n", "\\section*{Abstract}", "p\\begin{document}\n\\vspace*{1em}\n\\noindent\\hfill\\rule{0.86\\linewidth}{0.2mm}\\hfill\n\n\\begin{center}\n{\\LARGE\\bfseries My T\\par}\n\\vspace{1.5em}\nA B\\par\n\nC D\\par\n\\end{center}\n\n\\begin{center}\n{\\Large\\bfseries 摘要\\par}\n\\end{center}\n\n", "\\section*{Abstract}")
_DEMO = "Step1 <|point|> 123, 456 <|point|> 12,34 Response boxed\\{ " + "x" * 100
_placed_query("demo_blocks", fn.without_demo_blocks, f"A first paragraph of text\n\nshort latin words before\n\n{_DEMO}\n\nshort latin words after\n\nThinking with Visual Primitives\n\n文 ", f"\n\nlast latin words of all\n\n{_DEMO}", "A first paragraph of text\n\n文 ", "\n\n")


@query(rf"SELECT doc_id, {_TIDY} AS text FROM (SELECT doc_id, replace(text, '**', '') AS text FROM documents)")
def visual_marks(spark, sf_dir):
    ship(spark)
    return documents(spark, sf_dir).select("doc_id", scanners.visual_marks(F.replace(F.col("text"), F.lit("**"), F.lit(""))).alias("text"))


@query(r"SELECT doc_id, replace(replace(replace(replace(text, '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#') || '\textbackslash{}\_\{\}\textasciitilde{}fi' AS text FROM documents")
def latex_escaped(spark, sf_dir):
    ship(spark)
    return documents(spark, sf_dir).select("doc_id", scanners.latex_text(F.concat("text", F.lit("\\_{}~\ufb01"))).alias("text"))


_ESCAPED_LINES = r"""paras AS (SELECT doc_id, list_transform(string_split(replace(replace(replace(replace(text, '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), chr(10)), lambda x: trim(x)) AS p FROM documents)"""


@query(rf"""WITH {_ESCAPED_LINES} SELECT doc_id, '\documentclass{{article}}' || chr(10) || '\usepackage{{geometry}}' || chr(10) || '\geometry{{margin=1in}}' || chr(10) || '\title{{' || p[1] || '}}' || chr(10) || '\author{{}}' || chr(10)
|| '\date{{}}' || chr(10) || '\begin{{document}}' || chr(10) || '\maketitle' || chr(10) || '\sloppy' || chr(10) || array_to_string(list_transform(p[2:], lambda x: x || '\par'), chr(10) || chr(10)) || chr(10) || '\end{{document}}' || chr(10) AS text FROM paras""")
def text_articles(spark, sf_dir):
    """Each document's lines as the paragraphs of a text without markup, and the article that they become."""
    rows = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"), F.lit("none").alias("name"))
    return sources.article_of(rows)


@query(rf"""WITH {_TEXDOC}, lines AS (SELECT doc_id, unnest(string_split(tex, chr(10))) AS t, generate_subscripts(string_split(tex, chr(10)), 1) AS i FROM tex)
SELECT doc_id, string_agg(CASE WHEN position('%' IN t) = 1 THEN '' ELSE regexp_replace(t, '([^\\])%.*', '\1') END, chr(10) ORDER BY i) || chr(10) AS text FROM lines WHERE NOT starts_with(ltrim(t), '%') GROUP BY doc_id""")
def comments_stripped(spark, sf_dir):
    return texdoc(spark, sf_dir).select("doc_id", fn.strip_comments(F.col("text")).alias("text"))


@query(rf"""WITH {_TEXDOC}, plain AS (SELECT doc_id, regexp_replace(tex, '(?s)\\.', '', 'g') AS t FROM tex)
SELECT doc_id, CAST(length(t) - length(replace(t, '{{', '')) - (length(t) - length(replace(t, '}}', ''))) AS INTEGER) AS balance FROM plain""")
def brace_balance(spark, sf_dir):
    return texdoc(spark, sf_dir).select("doc_id", fn.brace_balance(F.col("text")).alias("balance"))


@query(r"""WITH pieces AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
counted AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters FROM pieces)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(t) >= 40 AND letters >= 20) AS kept FROM counted GROUP BY doc_id""")
def should_translate(spark, sf_dir):
    lines = glossary.lines_of(documents(spark, sf_dir))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(fn.should_translate(F.col("text"))).alias("kept"))


# --- spans ---

_SPANS = "spans AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 1000 AS INTEGER) AS s, CAST(l_partkey % 1000 + CAST(l_quantity AS INTEGER) AS INTEGER) AS e FROM lineitem)"
_MERGED = """before AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {0} WHERE s < e),
islands AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM before),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island)"""


def line_spans(spark, sf_dir, shift: int = 0):
    """Spans of lineitem; a broken quantity counts as the nearest whole number, a half as the even one, as SQL casts it."""
    start = (F.col("l_partkey") % 1000 + shift).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.rint("l_quantity").cast("int")).alias("end"))


@query(f'WITH {_SPANS}, {_MERGED.format("spans")} SELECT doc_id, s AS "start", e AS "end" FROM merged')
def spans_merged(spark, sf_dir):
    return spans.merged(line_spans(spark, sf_dir))


@query(f"""WITH {_SPANS}, {_MERGED.format("spans")}, bounds AS (SELECT doc_id, s, e FROM merged UNION ALL SELECT DISTINCT l_orderkey, 1100, 1100 FROM lineitem),
left_over AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS a, s AS z FROM bounds) SELECT doc_id, CAST(a AS INTEGER) AS "start", CAST(z AS INTEGER) AS "end" FROM left_over WHERE a < z""")
def spans_gaps(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("end", F.lit(1100))
    return spans.gaps(line_spans(spark, sf_dir), ends)


@query(f"""WITH {_SPANS}, points AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS x FROM spans), opened AS (SELECT DISTINCT doc_id, unnest(range(s + 10, e + 10)) AS x FROM spans),
left_over AS (SELECT * FROM points EXCEPT SELECT * FROM opened), runs AS (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS run FROM left_over)
SELECT doc_id, CAST(min(x) AS INTEGER) AS "start", CAST(max(x) + 1 AS INTEGER) AS "end" FROM runs GROUP BY doc_id, run""")
def spans_subtracted(spark, sf_dir):
    return spans.subtracted(line_spans(spark, sf_dir), line_spans(spark, sf_dir, 10))


_TITLED = rf"{_TEXDOC}, titled AS (SELECT doc_id, '\title{{T' || CAST(doc_id AS VARCHAR) || '}}' || chr(10) || replace(tex, '$$', '') AS t, 8 + length(CAST(doc_id AS VARCHAR)) AS z, length('\cite{{ref\_}}' || CAST(doc_id AS VARCHAR)) AS n FROM tex)"


def titled(spark, sf_dir):
    """texdoc below a title, without the junk that would read as displayed mathematics."""
    return texdoc(spark, sf_dir).select("doc_id", F.concat(F.lit("\\title{T"), F.col("doc_id").cast("string"), F.lit("}\n"), F.replace("text", F.lit("$$"), F.lit(""))).alias("text"))


@query(rf"""WITH {_TITLED}, found AS (SELECT doc_id, 0 AS a, 7 AS z FROM titled UNION ALL SELECT doc_id, z, z + 42 FROM titled
UNION ALL SELECT doc_id, position('\cite{{' IN t) - 1, position('\cite{{' IN t) - 1 + n FROM titled UNION ALL SELECT doc_id, length(t) - 14, length(t) FROM titled)
SELECT doc_id, CAST(a AS INTEGER) AS "start", CAST(z AS INTEGER) AS "end" FROM found""")
def protected_spans(spark, sf_dir):
    return spans.protected(titled(spark, sf_dir))


@query(rf"""WITH {_TITLED} SELECT doc_id, 7 AS "start", CAST(z AS INTEGER) AS "end" FROM titled""")
def front_matter_spans(spark, sf_dir):
    ship(spark)
    return titled(spark, sf_dir).select("doc_id", F.explode(scanners.front_matter_spans("text")).alias("s")).select("doc_id", "s.start", "s.end")


@query(r"""SELECT doc_id, 1 AS "start", CAST(length(text) + 25 AS INTEGER) AS "end" FROM documents WHERE length(text) - length(replace(text, chr(10), '')) < 42""")
def environment_spans(spark, sf_dir):
    """Short environments that aren't of prose; an itemize stays open."""
    ship(spark)
    made = F.concat(F.lit("x\\begin{proof}"), "text", F.lit("\\end{proof}\\begin{itemize}\\end{itemize}"))
    return documents(spark, sf_dir).select("doc_id", F.explode(scanners.environment_spans(made)).alias("s")).select("doc_id", "s.start", "s.end")


@query(r"""SELECT doc_id, 0 AS "open", CAST(length(text) + 8 AS INTEGER) AS "close" FROM documents UNION ALL SELECT doc_id, 2, 6 FROM documents UNION ALL SELECT doc_id, CAST(length(text) + 9 AS INTEGER), NULL FROM documents""")
def brace_match(spark, sf_dir):
    ship(spark)
    made = F.concat(F.lit("{a{\\}b}"), "text", F.lit("c}{"))
    return documents(spark, sf_dir).select("doc_id", F.explode(scanners.closing_braces(made)).alias("b")).select("doc_id", "b.open", "b.close")


# --- segments and translations ---

_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS original, b.text AS translated FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def pairs(spark, sf_dir):
    """Turns of a user and the answers to them, as source texts and translations."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    return asked.join(answered, ["conv_id", "turn"])


@query(f"""WITH {_PAIRS}, tidy AS (SELECT conv_id, turn, trim(regexp_replace(original, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(original || ' ' || translated, '\\s+', ' ', 'g')) AS b FROM pairs)
SELECT conv_id, turn, length(a) >= 80 AND length(b) > length(a) + 8 AND position(a IN b) BETWEEN 1 AND 25 AS echo FROM tidy""")
def large_echo(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", fn.large_echo(F.col("original"), F.concat("original", F.lit(" "), "translated")).alias("echo"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, repeat('译', 9) || ' ' || trim(translated) AS text FROM pairs")
def echo_stripped(spark, sf_dir):
    said = F.concat(F.lit("> "), F.trim("original"), F.lit(": "), F.repeat(F.lit("译"), F.lit(9)), F.lit(" "), F.trim("translated"))
    return pairs(spark, sf_dir).select("conv_id", "turn", fn.strip_echo(F.col("original"), said).alias("text"))


@query(f"""WITH {_PAIRS}, n AS (SELECT conv_id, turn, length(regexp_replace(original, '[^A-Za-z]', '', 'g')) AS letters FROM pairs)
SELECT conv_id, turn, letters >= 80 AND (turn * 2) < greatest(8, letters // 80) AS untranslated FROM n""")
def likely_untranslated(spark, sf_dir):
    made = F.repeat(F.lit("译"), (F.col("turn") * 2).cast("int"))
    return pairs(spark, sf_dir).select("conv_id", "turn", fn.untranslated(F.col("original"), made).alias("untranslated"))


def _segments(spark, sf_dir):
    lines = glossary.lines_of(documents(spark, sf_dir))
    return lines.select("doc_id", F.concat(F.lit("seg-"), F.lpad((F.col("line") + 1).cast("string"), 4, "0")).alias("id"), "text")


@query("""WITH segs AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, 'seg-' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, text FROM segs WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR i % 3 = 0""")
def resume_pending(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    number = F.substring("id", 5, 9).cast("int")
    done = rows.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", "id", F.when(number % 3 != 0, "译").otherwise("").alias("translation"))
    return segments.pending(rows, done)


# Documents as articles with an equation before their paragraphs, and the nodes they have: layout, blanks, paragraphs of prose.
_ARTICLE = r"""body AS (SELECT doc_id, replace(text, '$$', '') AS b FROM documents),
lined AS (SELECT doc_id, b, unnest(string_split(b, chr(10))) AS t, generate_subscripts(string_split(b, chr(10)), 1) AS i FROM body),
parts AS (SELECT doc_id, 0 AS i, 0 AS k, '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || '\begin{equation}E=' || CAST(doc_id AS VARCHAR) || '\end{equation}' AS t FROM body
UNION ALL SELECT doc_id, i, 0, chr(10) || chr(10) FROM lined UNION ALL SELECT doc_id, i, 1, regexp_extract(t, '^\s*') FROM lined UNION ALL SELECT doc_id, i, 2, trim(t) FROM lined WHERE trim(t) != ''
UNION ALL SELECT doc_id, i, 3, regexp_extract(t, '\s*$') FROM lined UNION ALL SELECT doc_id, 1000000, 0, chr(10) || '\end{document}' FROM body),
whole AS (SELECT doc_id, length(trim(b)) >= 40 AND length(regexp_replace(b, '[^\p{L}]', '', 'g')) >= 20 AS prose FROM body),
kinds AS (SELECT p.*, CASE WHEN k = 2 AND prose AND length(t) >= 40 AND length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 20 THEN 'translate' ELSE 'preserve' END AS kind FROM parts p JOIN whole USING (doc_id) WHERE t != ''),
opened AS (SELECT *, CASE WHEN kind = 'translate' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i, k), 'translate') = 'translate' THEN 1 ELSE 0 END AS opens FROM kinds),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node FROM opened),
nodes AS (SELECT doc_id, CAST(node AS BIGINT) AS node, kind, string_agg(t, '' ORDER BY i, k) AS text FROM islands GROUP BY doc_id, node, kind),
numbered AS (SELECT *, CASE WHEN kind = 'translate' THEN 'seg-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY node) AS VARCHAR), 4, '0') END AS segment_id FROM nodes)"""


def articles(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit("$$"), F.lit("")), F.lit("\n"), F.lit("\n\n"))
    head = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\begin{equation}E="), F.col("doc_id").cast("string"), F.lit("\\end{equation}\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.concat(head, text, F.lit("\n\\end{document}")).alias("text"))


def numbered_nodes(spark, sf_dir):
    return segments.numbered(segments.paragraph_nodes(articles(spark, sf_dir), most=1_000_000))


@query(f"WITH {_ARTICLE} SELECT doc_id, node, kind, text FROM nodes")
def paragraph_nodes(spark, sf_dir):
    return segments.paragraph_nodes(articles(spark, sf_dir), most=1_000_000)


@query(f"WITH {_ARTICLE} SELECT doc_id, node, segment_id FROM numbered")
def segment_numbering(spark, sf_dir):
    return numbered_nodes(spark, sf_dir).select("doc_id", "node", "segment_id")


@query(r"SELECT doc_id, replace(regexp_replace(text, '([.?!;:])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1), '¦') AS chunks FROM documents WHERE length(text) > 1")
def sentence_chunks(spark, sf_dir):
    """With room for one character, each sentence is a chunk, with the blanks before it."""
    docs = documents(spark, sf_dir).filter(F.length("text") > 1)
    return docs.select("doc_id", F.array_join(segments.sentence_chunks(F.col("text"), 1), "¦").alias("chunks"))


@query(r"SELECT doc_id, '\begin{equation}x\end{equation}' AS protected, 'A claim that is long enough to be prose: ' || replace(text, '$$', '') || '~\cite{k' || CAST(doc_id AS VARCHAR) || '}' AS prose FROM documents")
def inline_references(spark, sf_dir):
    """A reference stays with the text before it, other protected spans are pieces of their own."""
    ship(spark)
    made = F.concat(F.lit("\\begin{equation}x\\end{equation}A claim that is long enough to be prose: "), F.replace(F.col("text"), F.lit("$$"), F.lit("")), F.lit("~\\cite{k"), F.col("doc_id").cast("string"), F.lit("}"))
    found = documents(spark, sf_dir).select("doc_id", scanners.text_pieces(made).alias("p"))
    return found.select("doc_id", F.col("p")[0]["text"].alias("protected"), F.col("p")[1]["text"].alias("prose")).filter("protected is not null")


# What repair makes of a text that is taken for its own translation: no emphasis, percent signs escaped.
_FIXED = r"replace(regexp_replace({0}, '\*\*([^\n*][^\n]*?[^\n*])\*\*', '\1', 'g'), '%', '\%')"


@query(rf"""WITH {_ARTICLE}, turned AS (SELECT *, CAST(substr(segment_id, 5) AS INTEGER) % 4 AS turn FROM numbered)
SELECT doc_id, string_agg(CASE WHEN kind = 'preserve' OR turn = 1 THEN text WHEN turn = 0 THEN '译' || segment_id || ' 5\%' WHEN turn = 2 THEN '' ELSE {_FIXED.format("text")} END, '' ORDER BY node) AS text,
coalesce(string_agg(CASE WHEN turn = 3 THEN segment_id END, ' ' ORDER BY node), '') AS missing, coalesce(string_agg(CASE WHEN turn = 1 THEN segment_id END, ' ' ORDER BY node), '') AS reverted FROM turned GROUP BY doc_id""")
def apply_rebuild(spark, sf_dir):
    """Of every four segments one is translated, one has an error message for a translation, one an empty one and one none."""
    nodes = numbered_nodes(spark, sf_dir)
    turn = F.substring("segment_id", 5, 9).cast("int") % 4
    made = F.when(turn == 0, F.concat(F.lit("译"), "segment_id", F.lit(" 5%"))).when(turn == 1, F.lit("Traceback (most recent call last)")).when(turn == 2, F.lit(""))
    rows = nodes.filter("segment_id is not null").select("doc_id", F.col("segment_id").alias("id"), made.alias("translation"), F.lit(2).alias("ord"))
    stale = rows.withColumn("translation", F.lit("stale")).withColumn("ord", F.lit(1))
    return segments.rebuilt(nodes, rows.unionByName(stale)).select("doc_id", "text", F.array_join("missing", " ").alias("missing"), F.array_join("reverted", " ").alias("reverted"))


@query(rf"SELECT doc_id, {_FIXED.format('text')} || ' \cite{{k' || CAST(doc_id AS VARCHAR) || '}} 5\% \textbf{{x:y,z}} {{b}}' AS text FROM documents")
def fix_translation(spark, sf_dir):
    """Broken, invented and doubled references, open percent signs, blanks and wide signs at commands."""
    ship(spark)
    key = F.concat(F.lit(" \\cite{k"), F.col("doc_id").cast("string"), F.lit("}"))
    said = F.concat("text", F.lit(" \\cite{...} 5% \\textbf {x：y，z} {b}\\ref{none}\\cite{k}"))
    return documents(spark, sf_dir).select("doc_id", scanners.fixed(said, F.concat("text", key, F.lit(" 5\\% {b}"))).alias("text"))


@query(r"SELECT doc_id, text || ' {a}{b}' || ' rest' AS text FROM documents")
def joined_braces(spark, sf_dir):
    """A translation that loses a brace goes on as the original from there."""
    ship(spark)
    clean = F.regexp_replace("text", r"[*%]", "")
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.concat("text", F.substring(scanners.fixed(F.concat(clean, F.lit(" {a}{b lost")), F.concat(clean, F.lit(" {a}{b} rest"))), F.length(clean) + 1, F.lit(99))).alias("text"))


@query(f"""WITH {_ARTICLE} SELECT doc_id, segment_id AS id, '{{0}}' || chr(10) || chr(10) || text AS prompt, text AS original FROM numbered WHERE segment_id IS NOT NULL""".replace("{0}", translation._WRITTEN))
def translation_prompts(spark, sf_dir):
    rows = numbered_nodes(spark, sf_dir).filter("segment_id is not null").select("doc_id", F.col("segment_id").alias("id"), "text")
    return translation.written_prompts(rows).drop("system")


# --- scanners ---


@query(rf"""SELECT doc_id, '__LATEX_BLOCK_0004__{{article}}' || chr(10) || '__LATEX_BLOCK_0001__' || chr(10) || '__LATEX_BLOCK_0005__{{Doc ' || CAST(doc_id AS VARCHAR) || '}}' || chr(10) || replace(text, chr(10), chr(10) || chr(10))
|| ' see~__LATEX_BLOCK_0003__ and __LATEX_BLOCK_0000__ % note' || chr(10) || '__LATEX_BLOCK_0002__' AS masked, CAST(6 AS INTEGER) AS blocks FROM documents""")
def masked_blocks(spark, sf_dir):
    ship(spark)
    return texdoc(spark, sf_dir).select("doc_id", scanners.mask_blocks("text").alias("m")).select("doc_id", "m.masked", F.size("m.blocks").alias("blocks"))


@query(r"SELECT doc_id, 'Deep Nets in ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' end' AS text FROM documents")
def plain_text_for_terms(spark, sf_dir):
    made = F.concat(F.lit("\\emph Deep Nets in $x_1$ \\cite{a} "), "text", F.lit(" \\(y\\) \\ end"))
    return documents(spark, sf_dir).select("doc_id", fn.masked_plain(made).alias("text"))


@query(rf"WITH {_TEXDOC} SELECT doc_id, tex AS text FROM tex")
def mask_round_trip(spark, sf_dir):
    ship(spark)
    return texdoc(spark, sf_dir).select("doc_id", scanners.mask_round_trip("text").alias("text"))


@query(rf"WITH {_TEXDOC} SELECT doc_id, '\cite{{ref\_' || CAST(doc_id AS VARCHAR) || '}}' AS command, CAST(position('\cite{{' IN tex) - 1 AS INTEGER) AS start FROM tex")
def reference_commands(spark, sf_dir):
    ship(spark)
    return texdoc(spark, sf_dir).select("doc_id", F.explode(scanners.reference_spans("text")).alias("r")).select("doc_id", "r.command", "r.start")


@query(rf"WITH {_TEXDOC} SELECT doc_id, tex AS text FROM tex")
def references_repaired(spark, sf_dir):
    """Translations whose citation has lost its key get the original's back."""
    ship(spark)
    docs = texdoc(spark, sf_dir)
    broken = F.regexp_replace("text", r"\\cite\{[^}]*\}", r"\\cite{...}")
    return docs.select("doc_id", scanners.repaired_references(broken, "text").alias("text"))


# --- quality ---


#: One line of each kind of fault, put behind each document by its number.
_FAULT_LINES = (
    ("prompt_leak", "Here is the translation: x"),
    ("bad_reference_key", r"\cite{...}"),
    ("placeholder_leak", "__LATEX_BLOCK_0003__"),
    ("double_escaped_reference", r"\\ref{a}"),
    ("malformed_reference_command", r"\cite \cite{b}"),
    ("malformed_reference_key", r"\cite{a\b{c}}"),
    ("latex_control_word_split", r"\item sep -1"),
    ("latex_section_inside_prose", r"prose \section{y}"),
    ("english_residue", "译译译译译译译译 and then"),
    ("missing_list_item", r"\begin{itemize}z\end{itemize}"),
    ("markdown_artifact", "`x`"),
)
_NTH = "CASE doc_id % 11 {} END"
_FAULTY = f"""faulty AS (SELECT doc_id, text, {_NTH.format(' '.join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(_FAULT_LINES)))} AS kind,
{_NTH.format(' '.join(f"WHEN {i} THEN '{x}'" for i, (_, x) in enumerate(_FAULT_LINES)))} AS fault FROM documents),
judged AS (SELECT *, CASE WHEN kind IN ('english_residue', 'markdown_artifact') THEN 'warn' ELSE 'error' END AS severity FROM faulty)"""


def faulty(spark, sf_dir, drop: str = ""):
    docs = documents(spark, sf_dir)
    fault = F.coalesce(*(F.when(F.col("doc_id") % 11 == i, F.lit(x)) for i, (_, x) in enumerate(_FAULT_LINES)))
    text = F.replace(F.col("text"), F.lit(drop), F.lit("")) if drop else F.col("text")
    return docs.select("doc_id", F.concat(text, F.lit("\n"), fault).alias("text"))


@query(f"WITH {_FAULTY} SELECT severity, kind, count(*) AS n FROM judged WHERE severity = 'error' GROUP BY ALL")
def quality_faults(spark, sf_dir):
    return quality.blocking(quality.issues(faulty(spark, sf_dir))).groupBy("severity", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_FAULTY}, placed AS (SELECT *, replace(text, '*', '') || chr(10) || fault AS t, length(replace(text, '*', '')) + 1 AS place FROM judged)
SELECT doc_id, kind, severity, CAST(len(string_split(t, chr(10))) AS INTEGER) AS line,
CASE WHEN kind IN ('latex_section_inside_prose', 'english_residue') THEN fault ELSE trim(regexp_replace(substr(t, greatest(place - 90, 0) + 1, place + 90 - greatest(place - 90, 0)), '\\s+', ' ', 'g')) END AS snippet FROM placed""")
def quality_issues(spark, sf_dir):
    return quality.issues(faulty(spark, sf_dir, "*")).select("doc_id", "kind", "severity", "line", "snippet")


@query(f"""WITH {_FAULTY}, found AS (SELECT severity, kind, 1 AS n FROM judged UNION ALL SELECT 'warn', 'markdown_artifact', len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) FROM documents)
SELECT severity, kind, CAST(sum(n) AS BIGINT) AS n FROM found GROUP BY ROLLUP (severity, kind)""")
def quality_summary(spark, sf_dir):
    return quality.summary(quality.issues(faulty(spark, sf_dir)))


@query(f"""WITH {_FAULTY}, placed AS (SELECT *, replace(text, '*', '') || chr(10) || fault AS t, length(replace(text, '*', '')) + 1 AS place FROM judged),
cut AS (SELECT *, CASE WHEN kind IN ('latex_section_inside_prose', 'english_residue') THEN fault ELSE trim(regexp_replace(substr(t, greatest(place - 90, 0) + 1, place + 90 - greatest(place - 90, 0)), '\\s+', ' ', 'g')) END AS snippet,
{_NTH.format(' '.join(f"WHEN {i} THEN '{P.ADVICE[k]}'" for i, (k, _) in enumerate(_FAULT_LINES)))} AS advice FROM placed)
SELECT doc_id, '{P.REPORT_TITLE}' || chr(10) || chr(10) || '- Issue count: 1' || chr(10) || chr(10) || '1. **' || severity || ' / ' || kind || '** (line ' || CAST(len(string_split(t, chr(10))) AS VARCHAR) || ')' || chr(10)
|| '   - Snippet: `' || snippet || '`' || chr(10) || '   - Action: ' || advice || chr(10) AS report FROM cut""")
def quality_reports(spark, sf_dir):
    texts = faulty(spark, sf_dir, "*")
    return quality.report_text(quality.issues(texts), texts)


@query(f"""WITH {_PAIRS}, n AS (SELECT *, length(regexp_replace(original, '[^A-Za-z]', '', 'g')) AS letters FROM pairs)
SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) AS segment_id FROM n WHERE letters >= 80 AND turn % 3 != 2""")
def untranslated_segments(spark, sf_dir):
    """Segments whose translation is a few Chinese words; those that the document's text has no more (every third) aren't looked at."""
    rows = pairs(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("id"), F.col("original").alias("text"), F.concat(F.lit("a reply that is not in Chinese at all, turn "), F.col("turn").cast("string")).alias("translation"))
    kept = rows.filter(F.col("id").cast("int") % 3 != 2)
    tex = kept.groupBy("doc_id").agg(F.array_join(F.collect_list("translation"), "\n").alias("text"))
    whole = rows.select("doc_id").distinct().join(tex, "doc_id", "left").fillna("nothing", ["text"])
    found = quality.report(whole, rows, rows).filter("kind = 'likely_untranslated_segment'")
    return found.select("doc_id", "segment_id")


@query("""SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN '! Undefined ' ELSE 'LaTeX Error: ' END || event_type AS line FROM events WHERE event_id % 3 != 0""")
def critical_log_lines(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.lit("note ")).when(F.col("event_id") % 2 == 0, F.lit("! Undefined ")).otherwise(F.lit("LaTeX Error: "))
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("ok\n"), said, "event_type", F.lit("\nend")).alias("log"))
    return quality.critical_log_lines(logs)


# --- names and addresses ---


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) AS url FROM pages")
def safe_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.safe_url(F.col("url")).alias("url"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') WHEN 1 THEN 'hep-th/' || lpad(CAST(page_id AS VARCHAR), 7, '0') || 'v2' END AS name FROM pages")
def arxiv_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.arxiv_id(arxiv_urls(F.col("page_id"), F.col("url"))).alias("name"))


def arxiv_urls(page_id, url):
    """Addresses of the accepted and rejected forms, by a page's number."""
    i = page_id.cast("string")
    return F.when(page_id % 4 == 0, F.concat(F.lit("https://arxiv.org/pdf/2401."), F.lpad(i, 5, "0"), F.lit(".pdf"))).when(page_id % 4 == 1, F.concat(F.lit("http://www.arxiv.org/abs/hep-th/"), F.lpad(i, 7, "0"), F.lit("v2?x=1"))).when(page_id % 4 == 2, F.concat(F.lit("https://arxiv.org/abs/24.1"), i)).otherwise(url)


@query("SELECT page_id, CASE WHEN s = '' THEN 'task' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS s FROM pages)")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.slug(F.col("url")).alias("slug"))


@query("SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' _ ' || p_type AS name FROM part")
def artifact_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.artifact_name(F.concat("p_name", F.lit(" :/?\n "), "p_type", F.lit("..."))).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'https://arxiv.org/src/' || name || ' https://arxiv.org/e-print/' || name || ' https://arxiv.org/pdf/' || name || '.pdf' END AS addresses FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') WHEN 1 THEN 'hep-th/' || lpad(CAST(page_id AS VARCHAR), 7, '0') || 'v2' END AS name FROM pages)")
def source_addresses(spark, sf_dir):
    url = arxiv_urls(F.col("page_id"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.array_join(sources.source_urls(url), " "), F.lit(" "), sources.pdf_url(url)).alias("addresses"))


@query("SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '(?i)\\.pdf$', ''), '/', '-'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS slug FROM pages WHERE length(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')) > 0")
def source_slugs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter(F.length(F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")) > 0)
    return pages.select("page_id", fn.source_slug(F.col("url")).alias("slug"))


@query("SELECT p_partkey, 'Big ' || p_type || ' of ' || CAST(p_partkey AS VARCHAR) AS title, 'Big ' || p_type || ' of ' || CAST(p_partkey AS VARCHAR) AS name FROM part")
def titles(spark, sf_dir):
    """Titles of sources, in plain words, and the names of what is made of an arXiv article."""
    ship(spark)
    tex = F.concat(F.lit("x \\title [short]{\\textbf{Big} \\emph{\\textit{"), "p_type", F.lit("}} \\\\ of $"), F.col("p_partkey").cast("string"), F.lit("$\\thanks{}} y"))
    title = scanners.argument_of(tex, "title")
    name = fn.output_name(F.lit("https://arxiv.org/abs/2401.00001"), title, F.lit(None).cast("string"), F.lit("/w/project"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.plain_title(title).alias("title"), name.alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'xelatex' ELSE 'pdflatex' END AS compiler FROM documents")
def compilers(spark, sf_dir):
    tex = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("\\usepackage{ctex}")).otherwise(F.lit("")), "text")
    return documents(spark, sf_dir).select("doc_id", fn.compiler(tex, ["pdflatex", "xelatex"]).alias("compiler"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 3), [CAST(p_partkey % 9 + 1 AS BIGINT)]))), ' ') AS pages FROM part")
def page_specs(spark, sf_dir):
    spec = F.concat((F.col("p_size") + 2).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit(" , "), (F.col("p_partkey") % 9 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.page_numbers(spec), " ").alias("pages"))
