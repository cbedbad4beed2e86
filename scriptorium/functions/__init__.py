"""Column functions: built-in expressions only, so that they stay inside generated code and filters reach the scan."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import patterns as P
from scriptorium.session import ship

BLANK = r"(?U)\s+"


def compact(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rewrite(text: Column, rule: str) -> Column:
    """text after the named rule of patterns.REWRITES."""
    for pattern, replacement in P.REWRITES[rule]:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def normal_characters(text: Column) -> Column:
    """Arrows as commands, radicals as characters, no control characters but tab and line ends."""
    for arrow, command in P.ARROWS.items():
        text = F.replace(text, F.lit(arrow), F.lit(command))
    kangxi = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FE0)}
    table = P.RADICALS | {a: b for a, b in kangxi.items() if a != b}
    return F.translate(F.regexp_replace(text, P.CONTROLS, ""), "".join(table), "".join(table.values()))


def demo_block(text: Column) -> Column:
    """Whether a paragraph is what character recognition made of a picture with marks and coordinates."""
    hits = lambda pattern: F.regexp_count(text, F.lit(pattern))
    size = F.length(compact(text))
    points = hits(r"(?i)<\s*\|\s*/?\s*point\s*\|>|\\text\{\s*/?\s*point\s*\}|/point")
    places = hits(r"\d{2,4}\s*,\s*\d{2,4}") + hits(r"\{\d{2,4}\}\s*,\s*\{\d{2,4}\}") + hits(r"\[\d{2,4}\s*,\s*\d{2,4}\]")
    steps = hits(r"\bStep\d*\b|\bStart Exploring\b|\bResponse\b|\\boxed|boxed\\\{")
    one = lambda test: F.when(test, 1).otherwise(0)
    named = text.contains("Trigger\\_Placeholder") | text.contains("Trigger Placeholder")
    signals = one(named) * 2 + one(points >= 3) + one(places >= 6) + one(steps >= 2) + one((size > 220) & (points >= 2) & (places >= 4))
    return (size >= 80) & ((steps >= 1) & (points >= 2) & (size >= 100) | (signals >= 2))


def without_demo_blocks(text: Column) -> Column:
    """text without demo blocks, and without short pieces of Latin text right before one or in a row after one.

    A paragraph's kind is a letter (D demo, F short piece, N other), so that the rule for neighbours is a pattern over letters.
    """
    parts = with_gaps(text, r"(?U)\n\s*\n")
    letters = lambda b: F.length(F.regexp_replace(b, "[^A-Za-z]+", ""))
    short = lambda b: (compact(b) == "Thinking with Visual Primitives") | (n_cjk(b) == 0) & (letters(b) >= 12) & (F.length(compact(b)) <= 120)
    kinds = F.array_join(F.transform(parts, lambda p: F.when(demo_block(p["part"]), "D").when(short(p["part"]), "F").otherwise("N")), "")
    kinds = F.regexp_replace(F.regexp_replace(kinds, r"(?<=D)F|(?!\A)\GF", "X"), "F(?=D)", "X")
    # An array of one holds the letters, so that they are found once and not once for each paragraph.
    kept = lambda k: F.transform(parts, lambda p, i: F.concat(F.when(F.substring(k, i + 1, F.lit(1)).isin("D", "X"), "").otherwise(p["part"]), p["gap"]))
    whole = F.get(F.transform(F.array(kinds), lambda k: F.array_join(kept(k), "")), F.lit(0))
    # Most texts have no block of the kind; they skip the work by paragraph.
    may = text.rlike(r"(?i)point|Trigger|\bStep\d*\b|Start Exploring|Response|boxed")
    return F.regexp_replace(F.when(may, whole).otherwise(text), r"\n{4,}", "\n\n")


def with_gaps(text: Column, gap: str) -> Column:
    """The parts of text between matches of gap, each with the gap behind it (empty behind the last): an array of (part, gap)."""
    pairs = F.arrays_zip(F.split(text, gap, -1).alias("part"), F.regexp_extract_all(text, F.lit(gap), F.lit(0)).alias("gap"))
    return F.transform(pairs, lambda p: F.struct(p["part"].alias("part"), F.coalesce(p["gap"], F.lit("")).alias("gap")))


def reference_heading(text: Column) -> Column:
    """A heading before a bibliography whose first item is {[}1{]}; the word that stood for it goes."""
    before = F.regexp_extract(text, r"(?s)\A(.*?)(?dm:^)\{\[\}1\{\]\}", 1)
    found = text.rlike(r"(?dm)^\{\[\}1\{\]\}")
    rest = F.substring(text, F.length(before) + 1, F.length(text))
    head = F.regexp_replace(before, r"(?U)\A((?s:.*?))(?:References|参考文献)\s*", "$1\n\n")
    headed = F.concat(F.regexp_replace(head, r"(?U)\s+\z", ""), F.lit(f"\n\n{P.BIBLIOGRAPHY}\n\n"))
    return F.when(found, F.concat(F.when(head.contains(P.BIBLIOGRAPHY), head).otherwise(headed), rest)).otherwise(text)


def closed_longtables(text: Column) -> Column:
    return F.when(text.contains("{\\def\\LTcaptype"), F.regexp_replace(text, r"(\\end\{longtable\})(?!\s*\})", "$1\n}")).otherwise(text)


def with_chinese_support(text: Column) -> Column:
    """text with the packages that Chinese and addresses need behind its document class."""
    first = r"\A((?s:.*?)\\documentclass(?:\[[^\]]*\])?\{[^}]+\}\s*)"
    has = lambda *loads: sum((text.contains(x).cast("int") for x in loads), F.lit(0)) > 0
    loaded = F.when(has(r"\usepackage{ctex}", r"\usepackage[UTF8]{ctex}", r"\usepackage{xeCJK}"), text).otherwise(F.regexp_replace(text, first, r"$1\\usepackage[UTF8]{ctex}" + "\n"))
    return F.when(text.contains("\\url{") & ~text.contains(r"\usepackage{url}"), F.regexp_replace(loaded, first, r"$1\\usepackage{url}" + "\n")).otherwise(loaded)


def front_matter_texts(text: Column) -> Column:
    for source, target in P.FRONT_MATTER_TEXTS.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def front_matter_layout(text: Column) -> Column:
    """A first starred section with authors, before an abstract's, as a centred title block."""
    pattern = r"(?s)\A(.*?)(\\begin\{document\}\s*)(\\section\*\{([^}]*)\}\s*)(.*?)(\\section\*\{(Abstract|摘要)\}\s*)"
    group = lambda k: F.regexp_extract(text, pattern, k)
    authors, title = group(5), compact(group(4))
    people = F.filter(F.transform(F.split(authors, r"\n\s*\n"), strip), lambda x: x != "")
    fits = text.rlike(pattern) & ~authors.contains("\\section") & (F.length(authors) <= 5000) & (F.size(people) > 0) & (title != "")
    lines = F.array_join(F.transform(people, lambda x: F.concat(x, F.lit("\\par"))), "\n\n")
    taken = sum((F.length(group(k)) for k in (1, 2, 3, 5, 6)), F.lit(0))
    made = F.concat(
        group(1), group(2),
        F.lit("\\vspace*{1em}\n\\noindent\\hfill\\rule{0.86\\linewidth}{0.2mm}\\hfill\n\n\\begin{center}\n{\\LARGE\\bfseries "), title,
        F.lit("\\par}\n\\vspace{1.5em}\n"), lines,
        F.lit("\n\\end{center}\n\n\\begin{center}\n{\\Large\\bfseries "), group(7), F.lit("\\par}\n\\end{center}\n\n"),
        F.substring(text, taken + 1, F.length(text)),
    )
    return F.when(fits, made).otherwise(text)


def sanitized(rows: DataFrame, name: str = "text") -> DataFrame:
    """rows with a column of texts after all source rules, in the order in which they see each other's output.

    Each rule is a projection of its own: rules that look at their text several times would else make one expression that grows by
    their product. Rules of scanners are operators over Arrow batches.
    """
    from scriptorium.functions import scanners

    ship(rows.sparkSession)
    steps = (
        normal_characters, "cjk_punctuation", "pdf_output", "font_classes", merged_xcolor, "linebreak_dimensions", "section_phrases", "double_escaped_references",
        without_demo_blocks, reference_heading, "caption_prefixes", "markdown_emphasis", "reference_keys", "control_word_boundaries", "missing_list_items",
        scanners.without_fallback, "text_symbols", "math_fonts", scanners.marks, "jobname_probe", "item_space", "reference_brackets", closed_longtables,
        scanners.figures_and_underscores, "reference_keys", "control_word_boundaries", "missing_list_items",
    )
    for step in steps:
        if getattr(step, "__module__", "") == scanners.__name__:
            rows = scanners.scanned(rows, name, step)
        else:
            rows = rows.withColumn(name, rewrite(F.col(name), step) if isinstance(step, str) else step(F.col(name)))
    return rows


def n_cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.CJK))


def brace_balance(text: Column) -> Column:
    """Opening less closing braces, pairs of a backslash and any character left out."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    return F.regexp_count(plain, F.lit(r"\{")) - F.regexp_count(plain, F.lit(r"\}"))


#: What ends a line, as text readers see it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip_comments(text: Column) -> Column:
    """Lines without what follows an unescaped percent sign; lines that are only a comment go; ends in a line end."""
    lines = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?U)^\s*%"))
    return F.concat(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"(?d)(?<!\\)%.*", "")), "\n"), F.lit("\n"))


def should_translate(text: Column) -> Column:
    """Whether a piece of text holds prose worth translating: a heading of 3 letters, or 40 characters with 20 letters, and few commands."""
    s = strip(text)
    # Runs of other characters are removed: a match for each word, not for each letter.
    letters, commands = F.length(F.regexp_replace(s, r"\P{L}+", "")), F.regexp_count(s, F.lit(r"\\"))
    numbered = s.rlike(r"^(?:\{\[\}\d+\{\]\}|\[\d+\])")
    heading = s.rlike(P.HEADING)
    prose = (F.length(s) >= 40) & (letters >= 20) & (commands < F.greatest(F.lit(12), F.floor(letters / 3)))
    return (s != "") & ~numbered & F.when(heading, (letters >= 3) & (commands < F.greatest(F.lit(20), letters))).otherwise(prose)


def large_echo(original: Column, translated: Column) -> Column:
    """Whether the translation begins with a long source text."""
    a, b = compact(original), compact(translated)
    return (F.length(a) >= 80) & (F.length(b) > F.length(a) + 8) & F.position(a, b).between(1, 25)


def strip_echo(original: Column, translated: Column) -> Column:
    """The translation after the source text it begins with, if eight CJK characters follow."""
    a, b = strip(original), strip(translated)
    at = F.position(a, b)
    rest = F.regexp_replace(F.substring(b, at + F.length(a), F.length(b)), r"^[ \n\r\t:：-]+", "")
    return F.when((a != "") & at.between(1, 25) & (n_cjk(rest) >= 8), rest).otherwise(b)


def identity_frontmatter(text: Column) -> Column:
    return text.rlike(r"\\(?:author|email|affiliation|institution|orcid|city|country)\{") & (F.regexp_count(text, F.lit(r"\\")) >= 2)


def untranslated(original: Column, translated: Column) -> Column:
    """Whether a translation is probably still in the source language."""
    t, letters = strip(translated), F.length(F.regexp_replace(original, "[^A-Za-z]+", ""))
    settings = t.startswith("[") & t.rlike(r"\b[A-Za-z][A-Za-z-]*\s*=") & (n_cjk(t) < 8)
    few = (letters >= 80) & (n_cjk(translated) < F.greatest(F.lit(8), F.floor(letters / 80)))
    return F.when(large_echo(original, translated), True).when(identity_frontmatter(original) | settings, False).otherwise(few)


def slug(value: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.when(s == "", "task").otherwise(s)


def artifact_name(value: Column) -> Column:
    """A name that any file system takes, 120 characters at most."""
    s = F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(value, BLANK, " "), r'[<>:"/\\|?*\x00-\x1f]+', "_")), r"\.+$", "")
    s = F.when(F.length(s) > 120, F.regexp_replace(F.substring(s, 1, 120), r"[ ._-]+$", "")).otherwise(s)
    return F.when(s == "", "output").otherwise(s)


def safe_url(url: Column) -> Column:
    """A url without query and fragment."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)", 1)


def arxiv_id(url: Column) -> Column:
    """The identifier in an arXiv address, null if it has none."""
    path = F.regexp_extract(url, r"^https?://(?:www\.)?arxiv\.org/(?:abs|pdf|src|e-print)/([^?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.pdf$", "")
    return F.when(path.rlike(r"^(?:\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)$"), path)


def page_numbers(spec: Column, total: Column | None = None) -> Column:
    """The pages of a specification such as 1-3,5: sorted, each once; reversed ranges count forwards, pages start at 1 and end at total.

    Null if a part is neither a number nor two with a dash, or no page is left.
    """
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda x: x != "")
    good = F.forall(parts, lambda x: x.rlike(r"^\d{1,9}(?:\s*-\s*\d{1,9})?$"))
    first = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int")
    last = lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("int")
    most = F.coalesce(total, F.lit(2**31 - 2)) if total is not None else F.lit(2**31 - 2)
    low = lambda x: F.greatest(F.least(first(x), last(x)), F.lit(1))
    high = lambda x: F.least(F.greatest(first(x), last(x)), most)
    ranges = F.transform(parts, lambda x: F.when(low(x) <= high(x), F.sequence(low(x), high(x))).otherwise(F.array().cast("array<int>")))
    pages = F.array_sort(F.array_distinct(F.flatten(ranges)))
    return F.when(good & (F.size(pages) > 0), pages)


def source_slug(hint: Column) -> Column:
    """A name for what an address or a path points to."""
    address = hint.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    path = F.regexp_replace(F.regexp_extract(hint, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    label = F.when(path == "", F.regexp_extract(hint, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).otherwise(path)
    return slug(F.when(address, F.replace(F.regexp_replace(label, r"(?i)\.pdf$", ""), F.lit("/"), F.lit("-"))).otherwise(F.coalesce(F.nullif(stem(hint), F.lit("")), hint)))


def stem(path: Column) -> Column:
    """A path's last part without its last suffix."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def plain_title(tex: Column) -> Column:
    """A LaTeX title as plain words: arguments of commands stay, commands, braces and dollar signs go."""
    s = F.replace(tex, F.lit("\\\\"), F.lit(" "))
    for _ in range(4):
        s = F.regexp_replace(s, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\$([^$]*)\$", "$1"), r"\\[A-Za-z]+\*?", " ")
    return compact(F.regexp_replace(s, "[{}$]", " "))


def output_name(source: Column, title: Column, pdf: Column, project: Column) -> Column:
    """The name of what a run makes: an arXiv article's title or identifier, else the PDF's name, else the source's, else the project's."""
    address, name = source.rlike("^https?://"), arxiv_id(source)
    path = F.when(address, F.regexp_extract(source, r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(source)
    own = stem(path)
    own = F.when((own == "") | own.isin("project", "source", "output", "run"), stem(project)).otherwise(own)
    title = F.nullif(plain_title(title), F.lit(""))
    return artifact_name(F.when(name.isNotNull(), F.coalesce(title, name)).otherwise(F.coalesce(stem(pdf), own)))


def pdf_file_name(url: Column) -> Column:
    """The name under which a PDF from an address is kept."""
    name = F.regexp_extract(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", ""), r"([^/]*)$", 1)
    name = F.when(name == "", "remote.pdf").otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def needs_unicode(tex: Column) -> Column:
    """Whether a source asks for a compiler that reads Unicode (its first 10,000 characters tell)."""
    head = F.substring(tex, 1, 10_000)
    return sum((head.contains(x).cast("int") for x in ("ctex", "xeCJK", "fontspec", "xetex", "unicode-math", "中文")), F.lit(0)) > 0


def compiler(tex: Column, installed: list[str]) -> Column:
    """Which of the installed compilers takes a source; null if none does."""
    first = lambda *names: F.lit(next((n for n in names if n in installed), None))
    plain = first("pdflatex", "xelatex", "lualatex")
    return F.when(needs_unicode(tex), F.coalesce(first("lualatex", "xelatex"), plain)).otherwise(plain)


def html_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def masked_plain(text: Column) -> Column:
    """text without commands, mathematics and keys, as one line: what terms are looked for in."""
    hidden = text
    for pattern in P.MASKED:
        hidden = F.regexp_replace(hidden, f"(?s){pattern}", "__LATEX_BLOCK_0000__")
    hidden = F.replace(F.replace(hidden, F.lit("__LATEX_BLOCK_0000__"), F.lit(" ")), F.lit("\\"), F.lit(" "))
    return compact(F.when(text.rlike(r"[\\$|]"), hidden).otherwise(text))


def strip_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    s = strip(text)
    return F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, r"\A```[^\n]*\n?", ""), r"(?:\A|\n)[ \t]*```[ \t]*\z", ""))).otherwise(s)


def merged_xcolor(text: Column) -> Column:
    """One load of xcolor, with all loads' options in the order they came, behind the document class (else at the top)."""
    load = r"(?dm)^[ \t]*\\usepackage(?:\[([^\]]*)\])?\{xcolor\}[ \t]*\n?"
    options = F.array_distinct(F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(load), F.lit(1)), lambda x: F.transform(F.split(x, ","), strip))), lambda x: x != ""))
    line = F.concat(F.lit("\\usepackage"), F.when(F.size(options) > 0, F.concat(F.lit("["), F.array_join(options, ","), F.lit("]"))).otherwise(""), F.lit("{xcolor}\n"))
    rest = F.regexp_replace(text, load, "")
    head = F.regexp_extract(rest, r"(?s)\A(.*?\\documentclass(?:\[[^\]]*\])?\{[^}]+\}\s*)", 1)
    made = F.when(head == "", F.concat(line, rest)).otherwise(F.concat(head, F.lit("\n"), line, F.substring(rest, F.length(head) + 1, F.length(rest))))
    return F.when(text.rlike(load), made).otherwise(text)
