"""Scanners whose state no regular expression holds, as Arrow-batched functions of columns."""



import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium import patterns as P

_START = re.compile(P.REFERENCE_START)
_MASKED = [re.compile(f"({p})", re.S) for p in P.MASKED]
# What isn't text to translate, as whole matches.
PROTECTED = (
    r"\A(?:.*?\\begin\{document\}|.*?\\maketitle)",
    r"\\iffalse.*?\\fi",
    r"\$\$.*?\$\$",
    r"(?<!\\)\\\[.*?\\\]",
    r"\\begin\{center\}.*?\\end\{center\}",
    r"\\begin\{(?:tabular|tabular\*|tabularx|array)\}(?:\{.*?\})?.*?\\end\{(?:tabular|tabular\*|tabularx|array)\}",
    r"\\begin\{(?:equation|equation\*|align|align\*|multline|multline\*|gather|gather\*)\}.*?\\end\{[^}]+\}",
    r"\\begin\{(?:figure|figure\*|table|table\*|algorithm|lstlisting|thebibliography)\}.*?\\end\{[^}]+\}",
    P.REFERENCE_FLAT,
    r"\\(?:url|href|includegraphics|bibliography|bibliographystyle)\*?(?:\[[^\]]*\])?\{[^}]*\}",
    r"\\(?:begin|end)\{[^}]+\}",
    r"\\(?:newpage|clearpage|appendix|tableofcontents)\b",
)
# Environments of prose; any other is protected if it has fewer lines than the limit.
PROSE_ENVIRONMENTS = ("document", "abstract", "lemma", "definition", "sproof", "em", "emph", "textit", "textbf", "itemize", "enumerate")
SHORT_ENVIRONMENT = 42
# Commands whose braced argument is text again, up to the brace, by where they stand.
FRONT_MATTER = (r"\\(?:title|subtitle)\*?(?:\[[^\]]*\])?\{", r"(?i:\\(?:re)?newcommand\*?\s*\{\\[^{}]*title[^{}]*\}\s*(?:\[[^\]]*\]\s*){0,2}\{)")
OPENED = (r"\\caption\{", r"\\abstract\{")
_PROTECTED = [re.compile(p, re.S) for p in PROTECTED]
_ENVIRONMENT = re.compile(r"\\begin\{([a-zA-Z*]+)\}(.*?)\\end\{\1\}", re.S)
_FRONT_MATTER = re.compile("|".join(FRONT_MATTER))
_OPENED = re.compile("|".join(OPENED))
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", re.S)
_BRACE = re.compile(r"\\.|[{}]", re.S)


def closing_brace(text: str, at: int) -> int | None:
    """Where the brace that opens at ``at`` closes; a backslash hides the character behind it."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    return None


def references(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of commands whose argument is a key; one that never closes takes the rest."""
    at = 0
    while m := _START.search(text, at):
        end = closing_brace(text, m.end() - 1)
        at = len(text) if end is None else end + 1
        yield m.start(), at


def arguments(text: str, command: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) inside the braces that each match of ``command`` opens, where they close."""
    ends = ((m.end(), closing_brace(text, m.end() - 1)) for m in command.finditer(text))
    return [(a, b) for a, b in ends if b is not None]


def short_environments(text: str) -> list[tuple[int, int]]:
    """Environments not of prose with few lines. An environment inside another is not looked at."""
    return [m.span() for m in _ENVIRONMENT.finditer(text) if m[1] not in PROSE_ENVIRONMENTS and m[2].count("\n") < SHORT_ENVIRONMENT]


def guarded(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans to keep from translation, and spans inside them that are text again; neither merged nor in order."""
    kept = [m.span() for p in _PROTECTED for m in p.finditer(text)] + short_environments(text)
    opened = arguments(text, _FRONT_MATTER) + arguments(text, _OPENED) + [m.span(1) for m in _ABSTRACT.finditer(text)]
    return kept, opened


def islands(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one; empty ones go."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for x in spans if x[0] < x[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def protected(text: str) -> list[tuple[int, int]]:
    """Merged spans to keep, without the text inside them: steps up and down at the ends of both kinds, in order."""
    kept, opened = guarded(text)
    steps = sorted((at, up, cut) for cut, side in enumerate((islands(kept), islands(opened))) for a, b in side for at, up in ((a, 1), (b, -1)))
    level, out, last = [0, 0], [], 0
    for at, up, cut in steps:
        if level[0] and not level[1] and last < at:
            out.append((last, at))
        level[cut] += up
        last = at
    return islands(out)


_ONE_REFERENCE = re.compile(P.REFERENCE_FLAT, re.S)


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, text) in order: what is protected and what lies between; a lone reference belongs to the text before it."""
    out: list[tuple[str, str]] = []
    at = 0
    for a, b in protected(text):
        if at < a:
            out.append(("translate", text[at:a]))
        if out and out[-1][0] == "translate" and _ONE_REFERENCE.fullmatch(text[a:b].strip()):
            out[-1] = ("translate", out[-1][1] + text[a:b])
        else:
            out.append(("preserve", text[a:b]))
        at = b
    return [*out, ("translate", text[at:])] if at < len(text) else out


def mask(text: str) -> tuple[str, list[tuple[str, str]]]:
    """text with blocks as tokens, and (token, block) in the order found: pattern by pattern, each over what the one before left."""
    blocks: list[tuple[str, str]] = []
    for pattern in _MASKED:
        parts = pattern.split(text)
        tokens = [f"__LATEX_BLOCK_{k:04d}__" for k in range(len(blocks), len(blocks) + len(parts) // 2)]
        blocks += zip(tokens, parts[1::2], strict=True)
        parts[1::2] = tokens
        text = "".join(parts)
    return text, blocks


_TOKEN = re.compile(r"(?:\\_|_){2}LATEX(?:\\_|_)BLOCK(?:\\_|_)(\d{4,})(?:\\_|_){2}")


def unmask(text: str, blocks: list[tuple[str, str]]) -> str:
    """Blocks in their tokens' places, the last first, as a later block can hold an earlier token; tokens count with any of their underscores escaped."""
    plain = lambda m: f"__LATEX_BLOCK_{m[1]}__"
    text = _TOKEN.sub(lambda m: m[0] if m[0] == "\\" + plain(m) else plain(m), text)  # a backslash before a whole token is the text's own
    for token, block in reversed(blocks):
        text = text.replace(token, block)
    return text


_MATHS = re.compile(r"\\[()\[\]]|\$\$|\$|_")


def _escaped(part: str) -> str:
    """Underscores outside mathematics with a backslash."""
    out, at, inside = [], 0, ""
    for m in _MATHS.finditer(part):
        mark = m[0]
        if mark == "_":
            if not inside and part[m.start() - 1 : m.start()] != "\\":
                out += [part[at : m.start()], "\\_"]
                at = m.end()
        elif mark[0] == "$":
            inside = "" if inside == mark else mark
        elif mark in ("\\(", "\\["):
            inside = {"\\(": "\\)", "\\[": "\\]"}[mark]
        elif mark == inside:
            inside = ""
    return "".join(out) + part[at:]


def escape_underscores(text: str) -> str:
    """Underscores of prose get a backslash; protected spans and mathematics stay as they are."""
    out, at = [], 0
    for a, b in [*protected(text), (len(text), len(text))]:
        out += [_escaped(text[at:a]), text[a:b]]
        at = b
    return "".join(out)


def after_arguments(text: str, at: int, many: int) -> int | None:
    """Where a command that starts at ``at`` ends with ``many`` braced arguments; null if it has fewer."""
    m = re.compile(r"\\[A-Za-z]+\*?").match(text, at)
    end = m.end() if m else None
    for _ in range(many if m else 0):
        brace = re.compile(r"\s*\{").match(text, end)
        close = closing_brace(text, brace.end() - 1) if brace else None
        if close is None:
            return None
        end = close + 1
    return end


def without_fallback(text: str) -> str:
    """text without probes for a Chinese serif font: a comment stands for each whole one."""
    out, at = [], 0
    for m in re.finditer(r"\\IfFontExistsTF\{Source Han Serif CN\}", text):
        if m.start() >= at and (end := after_arguments(text, m.start(), 3)) is not None:
            out += [text[at : m.start()], "% CJK font fallback is handled by ctex"]
            at = end
    return "".join(out) + text[at:]


def marks(text: str) -> str:
    """Names of visual marks between bars, as they were before translation."""
    for name, plain in P.VISUAL_MARKS.items():
        text = re.sub(rf"\|\s*(/?)\s*{name}", rf"|\1{plain}", text)
        text = re.sub(rf"(?:(/)\s*)?{name}\s*\|", lambda m, plain=plain: (m[1] or "") + plain + "|", text)

    def tidied(m: re.Match) -> str:
        slash, name = re.match(r"(/?)(.*)", m[1].strip(), re.S).groups()
        return f"|{slash}{P.VISUAL_MARKS.get(name.strip(), name.strip())}|"

    return re.sub(r"\|\s*(/?.{1,4}?)\s*\|", tidied, text)


_HEADING = ("\\section", "\\subsection", "\\subsubsection")


def figures(text: str) -> str:
    """Image lines with the caption that follows, up to a blank line, a heading or the next image, inside a figure."""
    lines, out, at = text.splitlines(keepends=True), [], 0
    image = lambda x: r"\pandocbounded{\includegraphics" in x
    caption = lambda x: x.strip().startswith(("Figure ", "图"))
    stops = lambda x: not caption(x) and (not x.strip() or x.strip().startswith(_HEADING) or image(x))
    captions = [k for k, x in enumerate(lines) if caption(x)]
    while at < len(lines):
        start = next((k for k in range(at, len(lines)) if image(lines[k])), len(lines))
        out += lines[at:start]
        said = captions[bisect_left(captions, start)] if captions and captions[-1] >= start else None
        if said is None:
            out += lines[start:]
            break
        at = next((k for k in range(said + 1, len(lines)) if stops(lines[k])), len(lines))
        block = "".join(lines[start:at])
        out.append(block if r"\begin{figure}" in block or r"\begin{figure*}" in block else f"\\begin{{figure}}[tbp]\n\\centering\n{block.rstrip()}\n\\end{{figure}}\n")
    return "".join(out)


def figures_and_underscores(text: str) -> str:
    return escape_underscores(figures(text))


def argument(command: str) -> str:
    """What stands in a reference command's braces; the rest if they never close."""
    at = command.find("{")
    end = closing_brace(command, at) if at >= 0 else 0
    return command[at + 1 : end] if at >= 0 else ""


def first_argument(text: str, command: str) -> str | None:
    """The argument of the first such command, null if there is none or it never closes."""
    m = re.search(rf"\\{re.escape(command)}\s*(?:\[[^\]]*\])?\{{", text)
    end = closing_brace(text, m.end() - 1) if m else None
    return None if end is None else text[m.end() : end]


def escaped_text(text: str) -> str:
    """Plain text as LaTeX, in compatibility form."""
    return unicodedata.normalize("NFKC", text).translate(_ESCAPES)


# Characters that LaTeX reads as commands.
_ESCAPES = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def _broken(command: str) -> bool:
    key = argument(command).strip()
    return key in ("", "...") or any(c in key for c in "\\\n{}")


def restore_references(translated: str, original: str) -> str:
    """Reference commands of a translation matched with the original's: exact good ones stay, others take the next of their name.

    A broken one takes the first left over; one that the original has no more room for goes.
    """
    left = [original[a:b] for a, b in references(original)]
    name = lambda c: re.match(r"\\([A-Za-z]+)", c)[1]
    out, at = [], 0
    for a, b in references(translated):
        command = translated[a:b]
        pick = command if command in left and not _broken(command) else next((x for x in left if name(x) == name(command)), left[0] if left and _broken(command) else None)
        if pick is not None:
            left.remove(pick)
        out += [translated[at:a], pick or ""]
        at = b
    return "".join(out) + translated[at:]


def _python_rule(name: str) -> list[tuple[re.Pattern, str]]:
    """A rule of patterns.REWRITES for texts that are on a worker already."""
    return [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in P.REWRITES[name]]


_EMPHASIS = _python_rule("markdown_emphasis")
_KEY = re.compile(rf"({P.REFERENCE_START})([^{{}}]*)(?=\}})")
_SHORT_ARGUMENT = re.compile(r"(\\[a-zA-Z]{2,20}\{)([^}]*)(?=\})")
_WIDE = str.maketrans("：，", ":,")


def joined_at_braces(translated: str, original: str) -> str:
    """As much of the translation as has the original's braces in their order, and the original from there."""
    at = taken = 0
    for m in re.finditer("[{}]", original):
        k = translated.find(m[0], at)
        if k < 0:
            break
        at, taken = k + 1, m.end()
    return translated[:at] + original[taken:]


def balance(text: str) -> int:
    marks = [m[0] for m in _BRACE.finditer(text)]
    return marks.count("{") - marks.count("}")


def fix(translated: str, original: str) -> str:
    """A translation that LaTeX takes in the original's place, or the original where that can't be made.

    Markdown marks go, keys and references are the original's, percent signs are escaped, commands close up to their arguments.
    A translation with a program's error message or another number of environments is given up.
    """
    text = translated
    for pattern, by in _EMPHASIS:
        text = pattern.sub(by, text)
    keys = lambda t: restore_references(_KEY.sub(lambda m: m[1] + m[2].replace("\\_", "_"), t), original)
    text = re.sub(r"\\([a-zA-Z]{2,20})\s+\{", r"\\\1{", re.sub(r"(?<!\\)%", r"\\%", keys(text)))
    text = _SHORT_ARGUMENT.sub(lambda m: m[1] + m[2].translate(_WIDE), text)
    if "Traceback" in text or "[Local Message]" in text or original.count("\\begin") != text.count("\\begin"):
        return original
    if balance(original) != balance(text):
        text = joined_at_braces(text, original)
    return keys(text)


_FAULTS = [(kind, re.compile(p)) for kind, _, p in P.FAULTS]
_LIST = re.compile(r"\\begin\{(enumerate|itemize|description)\}(.*?)\\end\{\1\}", re.S)


def _after_options(body: str) -> str:
    """A list's body without the options in brackets that it begins with."""
    depth = 0
    for k, c in enumerate(body if body.startswith("[") else ""):
        depth += {"[": 1, "]": -1}.get(c, 0)
        if not depth:
            return body[k + 1 :].lstrip()
    return body


def fault_places(text: str) -> list[tuple[str, int]]:
    """(kind, place) of each fault that isn't one of a single line, in the order of the rules."""
    found = [(kind, m.start()) for kind, p in _FAULTS for m in p.finditer(text)]
    found += [("malformed_reference_key", a) for a, b in references(text) if any(c in argument(text[a:b]) for c in "\\\n{}")]
    bodies = ((m.start(), _after_options(m[2].lstrip())) for m in _LIST.finditer(text))
    return found + [("missing_list_item", at) for at, body in bodies if body and not body.startswith("\\item")]


def term_pattern(source: str) -> re.Pattern:
    """Where a term stands as whole words, whatever its case and white space."""
    words = r"\s+".join(re.escape(w) for w in source.strip().split(" "))
    return re.compile(rf"(?<![A-Za-z0-9]){words}(?![A-Za-z0-9])", re.I)


def snippets(texts: list[str], source: str, most: int = 2, reach: int = 70) -> list[str]:
    """Up to ``most`` different surroundings of a term's hits, in order."""
    found: list[str] = []
    pattern = term_pattern(source)
    for text in texts:
        for m in pattern.finditer(text):
            cut = " ".join(text[max(0, m.start() - reach) : m.end() + reach].split())
            if cut and cut not in found:
                found.append(cut)
            if len(found) >= most:
                return found
    return found


# Types as objects: workers import this module and have no session that could read their names.
_TEXT = T.StringType()
_BLOCKS = T.StructType().add("masked", _TEXT).add("blocks", T.ArrayType(T.StructType().add("token", _TEXT).add("original", _TEXT)))
_REFERENCES = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("command", _TEXT))
_SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
_BRACES = T.ArrayType(T.StructType().add("open", T.IntegerType()).add("close", T.IntegerType()))
_GUARDED = T.StructType().add("kept", _SPANS).add("opened", _SPANS)


def _texts(function) -> Callable:
    """function from text to text over a column; null stays null."""

    @F.pandas_udf(_TEXT)
    def mapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return mapped


@F.pandas_udf(_BLOCKS)
def mask_blocks(texts: pd.Series) -> pd.DataFrame:
    made = [mask(t) if t is not None else (None, []) for t in texts]
    return pd.DataFrame({"masked": [m for m, _ in made], "blocks": [[{"token": a, "original": b} for a, b in blocks] for _, blocks in made]})


@F.pandas_udf(_TEXT)
def mask_round_trip(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unmask(*mask(t)))


@F.pandas_udf(_REFERENCES)
def reference_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "command": t[a:b]} for a, b in references(t)])


escaped_underscores = _texts(escape_underscores)


@F.pandas_udf(_TEXT)
def repaired_references(translated: pd.Series, original: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else restore_references(t, o or "") for t, o in zip(translated, original, strict=True)], dtype=object)


def scanned(rows: DataFrame, name: str, function: Callable[[str], str]) -> DataFrame:
    """rows with a column of texts after function; null stays null.

    An operator of its own rather than an expression, so that filters and projections above are not written out below it.
    """
    at = rows.columns.index(name)

    def mapped(batches):
        for b in batches:
            texts = [None if t is None else function(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return rows.mapInArrow(mapped, rows.schema)


without_font_fallback = _texts(without_fallback)
visual_marks = _texts(marks)
wrapped_figures = _texts(figures)
latex_text = _texts(escaped_text)


def argument_of(text: Column, command: str) -> Column:
    """The argument of the first such command in text."""
    return _texts(lambda t: first_argument(t, command))(text)


_PIECES = T.ArrayType(T.StructType().add("kind", _TEXT).add("text", _TEXT))
_PLACES = T.ArrayType(T.StructType().add("kind", _TEXT).add("at", T.IntegerType()))


@F.pandas_udf(_PIECES)
def text_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"kind": k, "text": x} for k, x in pieces(t)])


@F.pandas_udf(_TEXT)
def fixed(translated: pd.Series, original: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or o is None else fix(t, o) for t, o in zip(translated, original, strict=True)], dtype=object)


@F.pandas_udf(_PLACES)
def faults(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"kind": k, "at": a} for k, a in fault_places(t)])


@F.pandas_udf(T.ArrayType(T.ArrayType(_TEXT)))
def term_snippets(texts: pd.Series, sources: pd.Series) -> pd.Series:
    """Of each row's texts, the snippets of each of its terms."""
    return pd.Series([[snippets([x for x in t if x is not None], s) for s in terms] for t, terms in zip(texts, sources, strict=True)], dtype=object)


@F.pandas_udf(_BRACES)
def closing_braces(texts: pd.Series) -> pd.Series:
    """Each opening brace of a text that isn't escaped, and where it closes."""
    return texts.map(lambda t: None if t is None else [{"open": m.start(), "close": closing_brace(t, m.start())} for m in _BRACE.finditer(t) if m[0] == "{"])


def _rows(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


@F.pandas_udf(_GUARDED)
def guarded_spans(texts: pd.Series) -> pd.DataFrame:
    made = [guarded(t or "") for t in texts]
    return pd.DataFrame({"kept": [_rows(k) for k, _ in made], "opened": [_rows(o) for _, o in made]})


@F.pandas_udf(_SPANS)
def front_matter_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _rows(arguments(t, _FRONT_MATTER)))


@F.pandas_udf(_SPANS)
def environment_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _rows(short_environments(t)))
