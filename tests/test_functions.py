"""Rules on short texts of our own."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium import functions as fn
from scriptorium import patterns, sources, streaming
from scriptorium.functions import scanners
from scriptorium.operators import glossary, quality, segments, spans
from scriptorium.sources import translation


def one(spark, build, *values):
    """What a column function gives for one row of strings."""
    names = [f"c{k}" for k in range(len(values))]
    rows = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return rows.select(build(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        ("cjk_punctuation", r"甲\（乙\）", "甲（乙）"),
        ("item_space", "\\item甲 \\itemsep2pt \\item b", "\\item 甲 \\itemsep2pt \\item b"),
        ("linebreak_dimensions", r"a \[3pt] \\[3pt]", r"a \\[3pt] \\[3pt]"),
        ("section_phrases", r"\S所示。\ref{s}", r"\S\ref{s}所示"),
        ("double_escaped_references", r"\\cref{a} \\\textbf{b}", r"\cref{a} \\\textbf{b}"),
        ("control_word_boundaries", r"\alpha中 \beta x", r"\alpha{}中 \beta x"),
        ("caption_prefixes", "Figure 3 | x\nTable 1| y", "图3 | x\n表1 | y"),
        ("text_symbols", r"\textless{} \textbar x", r"\textless{} \textbar{} x"),
        ("math_fonts", r"\mathbf{\hat{y}}", r"\hat{y}"),
        ("reference_brackets", "[7] A\n  [12] B", "{[}7{]} A\n  {[}12{]} B"),
        ("markdown_emphasis", "**bold** __under__ `code` **a**", "bold under code **a**"),
        ("missing_list_items", "\\begin{itemize}\nx\n\\end{itemize}\\begin{enumerate}\\item y\\end{enumerate}", "\\begin{itemize}\n\\item x\n\\end{itemize}\\begin{enumerate}\\item y\\end{enumerate}"),
    ],
)
def test_rewrites(spark, rule, text, expected):
    assert one(spark, lambda c: fn.rewrite(c, rule), text) == expected


def test_rewrites_of_null(spark):
    for rule in patterns.REWRITES:
        assert one(spark, lambda c, rule=rule: fn.rewrite(c, rule), None) is None


@pytest.mark.parametrize(
    ("build", "text", "expected"),
    [
        (fn.compact, " a\u00a0\u3000b\n c ", "a b c"),
        (fn.brace_balance, r"{a{b}\} \{", 1),
        (fn.strip_comments, "a % x\n% y\nb \\% c", "a \nb \\% c\n"),
        (fn.should_translate, r"\section{Old}", True),
        (fn.should_translate, "[12] " + "word " * 20, False),
        (fn.should_translate, "word " * 20, True),
        (fn.slug, " a/b c? ", "a-b-c"),
        (fn.slug, "??", "task"),
        (fn.artifact_name, 'a:/b  "c"..', "a_b _c_"),
        (fn.page_numbers, "3-", None),
        (fn.page_numbers, "a-b,1", None),
        (fn.page_numbers, "0", None),
        (fn.source_slug, "https://h/p/q r.PDF?x", "p-q-r"),
        (fn.source_slug, "http://h", "h"),
        (fn.source_slug, "/a/b c.tex", "b-c"),
        (fn.pdf_file_name, "https://h/", "remote.pdf"),
        (fn.strip_comments, "a\r\n \u3000% x\x0bb %c", "a\nb \n"),
        (fn.reference_heading, "text References \n{[}1{]} A", "text\n\n\\section*{参考文献}\n\n{[}1{]} A"),
        (fn.front_matter_layout, "\\begin{document}\\section*{T}\\section{x}\\section*{Abstract}", "\\begin{document}\\section*{T}\\section{x}\\section*{Abstract}"),
        (fn.artifact_name, "x" * 200, "x" * 120),
        (fn.arxiv_id, "https://arxiv.org/pdf/2401.01234v2.pdf", "2401.01234v2"),
        (fn.arxiv_id, "https://arxiv.example/abs/2401.01234", None),
        (fn.page_numbers, "3-1, 5,2", [1, 2, 3, 5]),
        (fn.strip_fence, "```tex\nx\n```", "x"),
        (fn.safe_url, "https://h/p?q#f", "https://h/p"),
    ],
)
def test_scalars(spark, build, text, expected):
    assert one(spark, build, text) == expected


def test_translations(spark):
    source = "word " * 40
    assert one(spark, fn.untranslated, source, source) is True
    assert one(spark, fn.untranslated, source, "译" * 30) is False
    assert one(spark, fn.untranslated, r"\author{A}\email{b} " + source, "x") is False
    assert one(spark, fn.strip_echo, "abc", "> abc: " + "译" * 8) == "译" * 8
    assert one(spark, fn.strip_echo, "abc", "abc: x") == "abc: x"
    assert one(spark, fn.large_echo, source, source + "x" * 20) is True


def test_references():
    text = r"a \cite[p. 1]{k{x}} \ref{b} \cite{open"
    assert [text[a:b] for a, b in scanners.references(text)] == [r"\cite[p. 1]{k{x}}", r"\ref{b}", r"\cite{open"]
    assert scanners.restore_references(r"\cite{...} x \ref{zz} \label{q}", r"\cite{k} \ref{b}") == r"\cite{k} x \ref{b} "
    assert scanners.restore_references(r"x \cite{k}", "none") == "x "
    assert scanners.escape_underscores(r"a_b $x_1$ \cite{c_d} \_ e") == r"a\_b $x_1$ \cite{c_d} \_ e"
    assert scanners.closing_brace(r"{a\}{b}}", 0) == 7 and scanners.closing_brace("{{}", 0) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab $\\{}[]|\n_%cite", max_size=60))
def test_masks_come_off(text):
    assert scanners.unmask(*scanners.mask(text)) == text


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8)), max_size=6))
def test_spans(spark, first, second):
    points = lambda rows: {(d, x) for d, s, n in rows for x in range(s, s + n)}
    frame = lambda rows: spark.createDataFrame([(d, s, s + n) for d, s, n in rows], "doc_id int, start int, end int")
    cover = lambda rows: sorted((r.doc_id, x) for r in rows for x in range(r.start, r.end))
    a, b = frame(first), frame(second)
    found = spans.merged(a).collect()
    assert cover(found) == sorted(points(first))
    assert len({(r.doc_id, r.start) for r in found} & {(r.doc_id, r.end) for r in found}) == 0
    assert cover(spans.subtracted(a, b).collect()) == sorted(points(first) - points(second))


def test_equal_spans_leave_no_order_open(spark):
    """Equal spans are one island, and the running sum takes them together: rows in any order give the same islands."""
    rows = [(d, s, e) for d in range(40) for s, e in ((0, 3), (5, 9), (5, 9), (5, 9), (20, 25), (20, 25))]
    found = spans.merged(spark.createDataFrame(rows, "doc_id int, start int, end int"))
    assert sorted(map(tuple, found.collect())) == [(d, s, e) for d in range(40) for s, e in ((0, 3), (5, 9), (20, 25))]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "sum(opens" in plan and "RangeFrame, unboundedpreceding$(), currentrow$()" in plan


def test_nodes_are_lossless(spark):
    texts = ["", "\n\nx", "a" * 50 + " word\n\n\n" + "short\n \n" + "more prose " * 9 + "\n", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    nodes = segments.numbered(segments.paragraph_nodes(docs))
    none = spark.createDataFrame([], "doc_id int, id string, translation string, ord int")
    back = {r.doc_id: (r.text, r.missing) for r in segments.rebuilt(nodes, none).collect()}
    assert all(back.get(k, ("", 0))[0] == t for k, t in enumerate(texts)) and back[2][1] == ["seg-0001", "seg-0002"]
    rows = spark.createDataFrame([(2, "seg-0001", "old", 1), (2, "seg-0001", "", 2), (2, "seg-0002", None, 1)], "doc_id int, id string, translation string, ord int")
    assert segments.rebuilt(nodes, rows).filter("doc_id = 2").first().missing == ["seg-0002"]


def test_faults(spark):
    texts = ["__LATEX_BLOCK_0003__", r"see \cite{...}", r"\\ref{a}", r"\cite \cite{b}", r"\item sep -1", "**x**", r"prose \section{y}", "译译译译译译译译 and then", "\\begin{itemize}z\\end{itemize}", "Here is the translation: x"]
    found = quality.issues(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    kinds = {r.doc_id: r.kind for r in found}
    assert kinds == dict(enumerate(["placeholder_leak", "bad_reference_key", "double_escaped_reference", "malformed_reference_command", "latex_control_word_split", "markdown_artifact", "latex_section_inside_prose", "english_residue", "missing_list_item", "prompt_leak"]))


def test_glossary(spark):
    replies = spark.createDataFrame([(1, '{"terms":[{"source":"A b","translation":"x","aliases":["1","2","3","4","5","6","7"]},{"source":"a B","translation":"y"},{"source":" ","translation":"z"}]}'), (2, '[{"source":"q","translation":"w"}]'), (3, "no json")], "doc_id int, reply string")
    rows = glossary.normalized(replies).orderBy("doc_id").collect()
    assert [(r.doc_id, r.source, r.translation, len(r.aliases), r.type) for r in rows] == [(1, "A b", "x", 6, "term"), (2, "q", "w", 0, "term")]
    lines = spark.createDataFrame([(1, 0, "A  b c"), (1, 1, "aa b"), (1, 2, "x (a b)")], "doc_id int, line int, text string")
    terms = spark.createDataFrame([("a b", "t")], "source string, translation string")
    assert {r.line for r in glossary.matches(lines, terms).collect()} == {0, 2}


def test_archives(spark, tmp_path):
    tex = b"\\documentclass{article}\\begin{document}\\end{document}"
    t, z = io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as out:
        for name in ("a/main.tex", "../evil.tex"):
            info = tarfile.TarInfo(name)
            info.size = len(tex)
            out.addfile(info, io.BytesIO(tex))
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("m.tex", tex)
    for name, content in (("t", t.getvalue()), ("z", z.getvalue()), ("g", gzip.compress(tex)), ("r", tex), ("n", b"none")):
        (tmp_path / name).write_bytes(content)
    found = sources.unpack(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.path[-1], r.member) for r in found) == [("g", "main.tex"), ("r", "main.tex"), ("t", "a/main.tex"), ("z", "m.tex")]


def test_projects(spark, tmp_path):
    for name, text in {"p/main.tex": "\\documentclass{article}\n\\input{part} % c\n\\include{gone}\n", "p/part.tex": "in part\n\\input{sub/deep.tex}", "p/sub/deep.tex": "deep", "q/only.tex": "\\documentclass{x}"}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    text = {r.doc_id: r.text for r in sources.with_includes(sources.read_tex(spark, str(tmp_path))).collect()}
    assert "in part" in text["p"] and "deep" in text["p"] and "\n% missing include: \\include{gone}\n" in text["p"] and text["q"] == "\\documentclass{x}\n"


def test_includes_by_folder_and_once(spark, tmp_path):
    files = {
        "p/main.tex": "\\documentclass{a}\n\\input{a/x}\n\\input{b/x}\n\\input{main}\n\\input{a/x.tex}\n\\include{B/Y}\n\\input{v1.2}",
        "p/a/x.tex": "AX \\input{z}", "p/b/x.tex": "BX \\input{a/z}", "p/a/z.tex": "AZ", "p/y.tex": "BY", "p/v1.tex": "V",
        "p/other.tex": "\\documentclass{a} manuscript Guidelines font \\cite{k} and more text than the other one has, so that only the words tell them apart from it",
        "q/merge.tex": "\\documentclass{a}",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.doc_id: r.text.split() for r in sources.with_includes(sources.read_tex(spark, str(tmp_path))).collect()}
    assert found == {"p": ["\\documentclass{a}", "AX", "AZ", "BX", "BY", "V"]}
    titles = {r.doc_id: r.title for r in sources.title_of(spark.createDataFrame([("p", "/p/m.tex", "\\documentclass{a}\\title{A \\emph{b}}"), ("q", "/q/x.tex", "\\title{Open")], "doc_id string, path string, content string")).collect()}
    assert titles == {"p": "A b", "q": None}


def test_translate_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id":1,"id":"seg-0001","text":"a"}\n')
    step = lambda rows: translation.translate(rows, lambda texts: [t.upper() for t in texts])
    for name in ("b", None):
        streaming.land(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", step)
        if name:
            (tmp_path / f"in/{name}.json").write_text('{"doc_id":1,"id":"seg-0002","text":"b"}\n')
    assert sorted(r.translation for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "B"]


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("a \\cite{k} b", ["\\cite{k}"]),
        ("p \\maketitle b \\newpage", ["p \\maketitle", "\\newpage"]),
        ("\\title{A {b} c}\\maketitle \\begin{document}x", ["\\title{", "}\\maketitle \\begin{document}"]),
        ("x $$a$$ \\[b\\] \\\\[2pt] y\\]", ["$$a$$", "\\[b\\]"]),
        ("\\begin{figure}i\\caption{Two {x}}j\\end{figure}z", ["\\begin{figure}i\\caption{", "}j\\end{figure}"]),
        ("\\begin{proof}" + "\n" * 41 + "\\end{proof}", ["\\begin{proof}" + "\n" * 41 + "\\end{proof}"]),
        ("\\begin{proof}" + "\n" * 42 + "\\end{proof}", ["\\begin{proof}", "\\end{proof}"]),
        ("\\begin{lemma}x\\end{lemma}", ["\\begin{lemma}", "\\end{lemma}"]),
        ("\\begin{abstract}x\\end{abstract}", ["\\begin{abstract}", "\\end{abstract}"]),
        ("\\newcommand{\\MyTitle}[1]{t}\\caption{open \\maketitle", ["\\newcommand{\\MyTitle}[1]{", "}\\caption{open \\maketitle"]),
        ("", []),
        (None, []),
    ],
)
def test_protected_spans(spark, text, kept):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted((r.start, r.end) for r in spans.protected(docs).collect())
    assert [text[a:b] for a, b in rows] == kept


@pytest.mark.parametrize(
    ("translated", "original", "expected"),
    [
        ("概览如~\\Cref{...}所示。\\autoref{fig:a-b}", "Shown in~\\autoref{fig:a-b}.", "概览如~\\autoref{fig:a-b}所示。"),
        ("习惯~\\cite{}\\cite{a2007,b2018}", "habits~\\cite{a2007,b2018}", "习惯~\\cite{a2007,b2018}"),
        ("没有引用~\\cite{invented}", "No reference.", "没有引用~"),
        ("\\eqref{\\noindent \\bf Proof \\eqref{Y-(3.1)}.}", "Proof \\eqref{Y-(3.1)}.", "\\eqref{Y-(3.1)}"),
        ("50% **很好** \\emph {a：b，c}", "x \\emph{y}", "50\\% 很好 \\emph{a:b,c}"),
        ("x [Local Message] y", "the original", "the original"),
        ("\\begin{a}\\end{a}", "none", "none"),
        ("甲 {乙} {丙", "a {b} {c} d", "甲 {乙} {c} d"),
        ("", "a", ""),
    ],
)
def test_fix(translated, original, expected):
    assert scanners.fix(translated, original) == expected


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. $\\\\{}[]|\n_%", max_size=80))
def test_pieces_are_lossless(text):
    found = scanners.pieces(text)
    assert "".join(x for _, x in found) == text and all(x for _, x in found)
    a = scanners.protected(text)
    assert a == scanners.islands(a) and scanners.protected(text + "\\cite{k}")[-1][1] == len(text) + 8


def test_tokens_come_back_in_any_form():
    masked, blocks = scanners.mask(r"a $x$ \cite{b}")
    for form in ("__LATEX_BLOCK_0000__", r"\_\_LATEX\_BLOCK\_0000\_\_", r"\__LATEX_BLOCK\_0000_\_"):
        assert scanners.unmask(masked.replace("__LATEX_BLOCK_0000__", form), blocks) == r"a $x$ \cite{b}"


def test_underscores_of_prose_only():
    text = r"\documentclass{my_class}\begin{document}a_b \(c_d\) $$e_f$$ \begin{figure}g_h\end{figure} \_ i_j"
    assert scanners.escape_underscores(text) == text.replace("a_b", r"a\_b").replace("i_j", r"i\_j")


def test_segments_keep_equations_and_references(spark):
    tex = "\\begin{document}\n\\begin{equation}x=1\\end{equation}\nThe method of this paper is shown in~\\autoref{fig:a}.\n\n" + "A sentence that ends here. " * 300 + "\n\\end{document}"
    nodes = segments.numbered(segments.paragraph_nodes(spark.createDataFrame([(1, tex), (2, None), (3, "")], "doc_id int, text string"))).orderBy("node").collect()
    assert "".join(n.text for n in nodes) == tex
    said = [n.text for n in nodes if n.kind == "translate"]
    assert said[0] == "The method of this paper is shown in~\\autoref{fig:a}" and [n.segment_id for n in nodes if n.segment_id] == ["seg-0001", "seg-0002", "seg-0003"]
    assert all(len(x) <= 5000 for x in said) and not any("equation" in x for x in said)


def test_sentence_chunks_by_brute_force(spark):
    import re

    def brute(text, most):
        if len(text) <= most:
            return [text]
        out, chunk = [], ""
        for piece in filter(None, re.split(r"(?<=[.?!;:。！？；：])(\s+)", text)):
            if len(chunk) + len(piece) > most and chunk.strip():
                out, chunk = [*out, chunk], ""
            chunk += piece
        return [*out, chunk] if chunk else out

    texts = ["", "One. Two!  Three?\nFour: five; six。七 八", " . a", "no end at all " * 9, "x. " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for most in (1, 7, 20, 1000):
        found = {r.k: r.c for r in docs.select("k", segments.sentence_chunks(F.col("text"), most).alias("c")).collect()}
        assert found == {k: brute(t, most) for k, t in enumerate(texts)}


def test_contexts_by_brute_force(spark, sf_dir):
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 10 = 0")
    lines = glossary.plain(glossary.lines_of(docs))
    best = glossary.candidates_in(lines)
    found = {(r.doc_id, r.source): r.contexts for r in glossary.contexts(best, lines).collect()}
    texts = {r.doc_id: [" ".join(x.split()) for x in r.text.split("\n")] for r in docs.collect()}
    expected = {}
    for r in best.collect():
        pattern = re.compile(rf"(?<![A-Za-z0-9]){r.source.replace(' ', chr(92) + 's+')}(?![A-Za-z0-9])", re.I)
        cuts = [" ".join(t[max(0, m.start() - 70) : m.end() + 70].split()) for t in texts[r.doc_id] for m in pattern.finditer(t)]
        expected[r.doc_id, r.source] = list(dict.fromkeys(cuts))[:2]
    assert found == expected and len(found) > 30
    lines = spark.createDataFrame([(1, 0, "start of art and ART"), (1, 1, "the art")], "doc_id int, line int, text string")
    assert glossary.contexts(spark.createDataFrame([(1, "art")], "doc_id int, source string"), lines).first().contexts == ["start of art and ART", "the art"]


def test_matches_of_any_script_and_alias(spark):
    lines = spark.createDataFrame([(1, 0, "the Αβ model"), (1, 1, "C++ and neural  nets"), (2, 0, "αβ, NN; start"), (2, 1, "NNs aΑβ")], "doc_id int, line int, text string")
    terms = spark.createDataFrame([("Αβ", "甲", []), ("neural net", "网", ["Neural Nets", "NN"]), ("++", "加", None), ("art", "艺", None), ("*", "星", ["zz"])], "source string, translation string, aliases array<string>")
    found = {(r.doc_id, r.line, r.source) for r in glossary.matches(lines, terms).collect()}
    assert found == {(1, 0, "Αβ"), (2, 0, "Αβ"), (1, 1, "neural net"), (2, 0, "neural net")} | set()
    own = terms.limit(2).withColumn("doc_id", F.lit(2))
    assert {(r.doc_id, r.line) for r in glossary.matches(lines, own).collect()} == {(2, 0)}
    assert glossary.matches(lines, terms.limit(0)).isEmpty()


@pytest.fixture
def keep(spark, tmp_path):
    """Writes what a step made and reads it again."""
    kept = []

    def keep(rows, label):
        kept.append(label)
        path = str(tmp_path / f"kept{len(kept)}")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    return keep


def test_report_and_repair(spark, keep):
    tex = "\\begin{document}\nThe first paragraph is long enough to be translated~\\cite{a}.\n\nThe second paragraph is long enough to be translated.\n\\end{document}"
    nodes = segments.numbered(segments.paragraph_nodes(spark.createDataFrame([(1, tex)], "doc_id int, text string")))
    rows = spark.createDataFrame([(1, "seg-0001", "第一段 \\cite{...} 已经译好", 1), (1, "seg-0002", "第二段 \\item sep -1 已经译好", 1)], "doc_id int, id string, translation string, ord int")
    final, found = quality.repaired(keep(nodes, "nodes"), rows, keep=keep)
    assert {r.id: r.translation for r in final.collect()}["seg-0001"] == "第一段 \\cite{a} 已经译好"
    kinds = sorted((r.kind, r.source, r.segment_id, r.line is None) for r in found.collect())
    assert kinds == [("latex_control_word_split", "translated.tex", None, False), ("latex_control_word_split", "translations.jsonl", "seg-0002", True)]
    back = quality.loaded(quality.payload(found))
    assert back.count() == 2 and quality.blocking(back).count() == 2 and quality.loaded(spark.createDataFrame([(1, "no")], "doc_id int, payload string")).isEmpty()
    assert "1. **error / latex_control_word_split** (line 4)" in quality.report_text(found, nodes).first().report
    assert "No obvious" in quality.report_text(found.limit(0), nodes).first().report


ARTICLE = "\\documentclass{article}\n\\begin{document}\n\\title{A Census of Dashboard Designs in the Wild of Research}\n\\maketitle\nDashboard designs are many, and dashboard designs use KPI boards; a KPI board has a KPI~\\cite{a_b}.\n\n\\input{part}\n\\end{document}\n"


@pytest.fixture
def chinese():
    def model(prompts):
        """A model that knows one term, forgets it at first, and leaves one text in English until it is told."""
        out = []
        for p in prompts:
            if "Return JSON" in p:
                out.append('```json\n{"terms": [{"source": "dashboard designs", "translation": "仪表盘设计", "type": "term", "aliases": [], "note": ""}]}\n```')
            elif p.startswith("Revise"):
                out.append(p.rpartition("Translation:\n")[2] + "仪表盘设计")
            elif "stubborn" in p and "too much English" not in p:
                out.append("This stays in English, all of it.")
            else:
                tokens = " ".join(__import__("re").findall("__LATEX_BLOCK_[0-9]{4}__", p.rpartition("\n\n")[2]))
                out.append("这是一段足够长的中文译文，用来测试整个流程 " + tokens)
        return out

    return model


def test_flow(spark, tmp_path, chinese, keep):
    from scriptorium.operators import flow

    (tmp_path / "p").mkdir()
    (tmp_path / "p/main.tex").write_text(ARTICLE)
    (tmp_path / "p/part.tex").write_text("A stubborn paragraph, which a model leaves in English once, has eighty letters and a few more than that.\n")
    made = flow.run(sources.read_tex(spark, str(tmp_path)), chinese, keep=keep)
    text = made.sources.first().text
    assert "\\cite{a_b}" in text and "\\usepackage[UTF8]{ctex}" in text and "仪表盘设计" in text and "stubborn" not in text and "LATEX" not in text
    assert [(r.changed, r.review_attempts, len(r.missing_after)) for r in made.review.collect()] == [(True, 1, 0)] * made.review.count() and made.review.count() > 0
    row = made.summary.first()
    assert (row.segments, row.translated, row.missing, row.blocking, row.status) == (2, 2, 0, 0, "succeeded")
    attempts = {r.id: (r.attempts, r.suspicious) for r in made.translations.collect()}
    assert sorted(attempts.values()) == [(1, False), (2, False)]


def test_command_line(spark, tmp_path, capsys, chinese):
    from scriptorium.__main__ import main

    (tmp_path / "in/p").mkdir(parents=True)
    (tmp_path / "in/p/main.tex").write_text(ARTICLE)
    at = ["--work", str(tmp_path / "work"), "--project", str(tmp_path / "in")]
    for step in ("prepare", "prompts", "glossary", "translate", "translate", "review", "apply", "check"):
        assert main([step, *at], spark, chinese) == 0
    done = spark.read.json(str(tmp_path / "work/sources")).first()
    assert "missing include: \\input{part}" in done.text and "中文译文" in done.text
    assert spark.read.json(str(tmp_path / "work/prompts")).count() == 1 and "Issue count" in spark.read.json(str(tmp_path / "work/report")).first().report
    assert "pre-wrap" in spark.read.json(str(tmp_path / "work/debug")).first().html
    assert main(["config"]) == 0 and main(["paths"]) == 0 and "SCRIPTORIUM_MODEL" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["apply", "--work", str(tmp_path / "none")], spark)


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\n译"), (1, None)], "k int, text string")
    sources.write_jsonl(rows, str(tmp_path / "t"), "k")
    assert [tuple(r) for r in sources.read_jsonl(spark, str(tmp_path / "t"), "k int, text string").orderBy("k").collect()] == [(1, None), (2, "b\n译")]
    (tmp_path / "bad.json").write_text("{no\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_jsonl(spark, str(tmp_path / "bad.json"), "k int").collect()


class Service:
    """A network that answers from a list of (method and part of the address, status, content), each once or, with a star, always."""

    def __init__(self, *rules):
        self.rules, self.seen, self.slept = list(rules), [], []

    def __call__(self, method, url, headers, data, timeout):
        from scriptorium.sources.remote import Reply

        self.seen.append((method, url, data))
        for rule in self.rules:
            verb, _, part = rule[0].rstrip("*").partition(" ")
            if verb == method and part in url:
                if not rule[0].endswith("*"):
                    self.rules.remove(rule)
                if rule[1] == 0:
                    raise OSError("reset")
                return Reply(rule[1], rule[2])
        return Reply(404, b"")


def test_remote_sources(tmp_path):
    from scriptorium.sources import remote

    net = Service(("GET x", 0, b""), ("GET x", 503, b""), ("GET x", 200, b"body"))
    assert remote.download("http://x", str(tmp_path / "f"), http=net, sleep=net.slept.append) == 4 and net.slept == [2, 4]
    with pytest.raises(OSError, match="404"):
        remote.request("GET", "http://y", http=net, sleep=net.slept.append)
    assert remote.put_file("http://u", b"pdf", 9, 2, http=Service(("PUT u", 500, b""), ("PUT u", 200, b"")), sleep=net.slept.append) == (True, None)
    assert remote.put_file("http://u", b"pdf", 9, 2, http=Service(), sleep=net.slept.append) == (False, "HTTP 404")
    tex = b"\\documentclass{a}\\begin{document}\\end{document}"
    files, pdf = remote.arxiv_project("2401.00001", http=Service(("GET e-print", 200, gzip.compress(tex)), ("GET pdf", 200, b"%PDF")))
    assert files == [("main.tex", tex)] and pdf == b"%PDF" and remote.arxiv_project("2401.00002", http=Service()) is None
    assert [remote.pdf_name(u) for u in ("http://h/a.PDF?x", "http://h/a", "http://h/")] == ["a.PDF", "a.pdf", "remote.pdf"]


def test_conversion_services():
    from scriptorium.sources import remote

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("main.tex", "x")
    ok = lambda **data: __import__("json").dumps({"code": "success", "data": data}).encode()
    after = [("POST convert/parse", 200, ok()), ("GET result", 200, ok(status="processing")), ("GET result", 200, ok(status="success", url="http://z")), ("GET z", 200, packed.getvalue())]
    net = Service(("POST preupload", 200, ok(uid="7", url="http://up")), ("PUT up", 200, b""), ("GET status", 200, ok(status="processing")), ("GET status", 200, ok(status="success")), *after)
    assert remote.convert_doc2x(b"pdf", "k", "m", http=net, sleep=net.slept.append) == [("main.tex", b"x")] and net.slept == [3, 3]
    lost = Service(("POST preupload", 200, ok(uid="7", url="http://up")), ("GET status", 200, ok(status="success")), ("GET status", 200, ok(status="success")), *after)
    assert remote.convert_doc2x(b"pdf", "k", "m", http=lost, sleep=lost.slept.append) == [("main.tex", b"x")]
    with pytest.raises(RuntimeError, match="refused"):
        remote.convert_doc2x(b"pdf", "k", "m", http=Service(("POST preupload", 200, b'{"code": "no"}')), sleep=net.slept.append)
    ticks = iter(range(99))
    assert remote.upload_seen("7", {}, 5, clock=lambda: next(ticks), sleep=lambda _: None, http=Service(("GET status*", 200, b'{"code": "busy"}')))[0] is False
    net = Service(("POST v3/pdf", 200, b'{"pdf_id": "9"}'), ("GET 9.tex", 200, packed.getvalue()), ("GET v3/pdf/9", 200, b'{"status": "split"}'), ("GET v3/pdf/9", 200, b'{"status": "completed"}'))
    net.rules.sort(key=lambda r: r[0] == "GET 9.tex")
    assert remote.convert_mathpix(b"pdf", "i", "k", http=net, sleep=net.slept.append) == [("main.tex", b"x")] and b"tex.zip" in net.seen[0][2]


def test_chat_backend():
    from scriptorium.sources.translation import ChatBackend

    replies, slept = [(503, b""), (200, b"no json"), (200, b'{"choices": [{"message": {"content": " hi "}}]}')], []
    chat = ChatBackend("http://m/v1/", "name", "secret", post=lambda *a: replies.pop(0), sleep=slept.append)
    assert chat(["p"]) == ["hi"] and slept == [2, 4] and "secret" not in repr(chat)
    with pytest.raises(RuntimeError, match="2 attempts"):
        ChatBackend("http://m", "n", "k", tries=2, post=lambda *a: (500, b""), sleep=slept.append)(["p"])


def test_replies_agree_with_columns(spark):
    from scriptorium.sources import translation as tr

    source = "word " * 40
    pairs = [(source, source + "x" * 20), (source, "译" * 3), (source, "译" * 30), ("\\author{A}\\email{b} " + source, "x"), (source, "[a=1] x"), ("short", "x"), ("abc", "> abc: " + "译" * 8), ("abc", "abc: x"), ("", "y")]
    for a, b in pairs:
        assert tr.left_english(a, b) == one(spark, fn.untranslated, a, b) and tr.without_echo(a, b) == one(spark, fn.strip_echo, a, b)
    for reply in ("```tex\nx\n```", "x", "```\n```", "```json\n{}", " ```a\nb``` "):
        assert tr.unfenced(reply) == one(spark, fn.strip_fence, reply)


def test_config(tmp_path):
    from scriptorium import config

    (tmp_path / "e").write_text("# no\nexport SCRIPTORIUM_API_KEY='k'\nSCRIPTORIUM_MODEL=m\n=x\nnone\n")
    env = {"SCRIPTORIUM_MODEL": "mine", "SCRIPTORIUM_HOME": str(tmp_path)}
    assert config.load(str(tmp_path / "e"), env)[0] == tmp_path / "e" and env["SCRIPTORIUM_API_KEY"] == "k" and env["SCRIPTORIUM_MODEL"] == "mine"
    with pytest.raises(ValueError, match="SCRIPTORIUM_BASE_URL"):
        config.model_settings(env)
    assert config.model_settings(env, base_url="u") == {"key": "k", "base_url": "u", "model": "mine"} and config.status(env)["SCRIPTORIUM_BASE_URL"] is False
    assert config.conversion_method("text", env) == "text" and config.conversion_method("auto", env | {"DOC2X_API_KEY": "d"}) == "doc2x"
    with pytest.raises(ValueError, match="DOC2X"):
        config.conversion_method("auto", env)


def test_tools(tmp_path):
    from types import SimpleNamespace

    from scriptorium import tools

    calls = []

    def call(command, **_how):
        calls.append(command)
        if command[0] == "pdftoppm":
            open(f"{command[-1]}.png", "w").close()
        if command[0] == "xelatex":
            (tmp_path / "m.pdf").write_text("x")
        return SimpleNamespace(returncode=0, stdout="Title: t\nPages:          3\n")

    (tmp_path / "m.aux").write_text("\\bibdata{refs, more}")
    (tmp_path / "refs.bib").write_text("")
    assert tools.compile_once("xelatex", tmp_path, "m", call=call, which=lambda c: c) == (True, True)
    assert [c[0] for c in calls] == ["xelatex", "bibtex", "xelatex", "xelatex", "pdfinfo"]
    assert tools.page_count("Pages: 12\n") == 12 and tools.page_count("none") is None and tools.installed(lambda c: c == "pdflatex" or None) == ["pdflatex"]
    (tmp_path / "n.pdf").write_text("x")
    pack = tools.review_pack(tmp_path / "m.pdf", tmp_path / "n.pdf", tmp_path / "pack", [1, 2, 9], call, lambda c: c)
    assert __import__("json").loads((pack / "manifest.json").read_text())["pages"] == [1, 2]
