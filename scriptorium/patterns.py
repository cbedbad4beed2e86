"""Fixed values that results depend on: word lists, commands and the patterns of single-pattern rules, in Java's dialect."""

from __future__ import annotations

# Words that neither begin nor end a term.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this",
    "to", "we", "with", "our", "via", "can", "using", "use", "used",
)
# Phrases too general to be terms.
GENERIC_PHRASES = ("abstract unavailable", "related work", "introduction", "conclusion", "experimental results", "future work", "this paper", "our paper", "our method", "proposed method", "proposed framework", "state of the art")
# Commands whose argument is a key.
REFERENCE_COMMANDS = "Cref|cref|Crefrange|crefrange|autoref|Autoref|ref|eqref|pageref|nameref|cite|cites|citep|citet|citealp|citealt|citeauthor|citeyear|label"
REFERENCE_START = rf"\\(?:{REFERENCE_COMMANDS})\*?(?:\[[^\]]*\])*\{{"
REFERENCE_FLAT = REFERENCE_START + r"[^{}]*\}"
# What counts as a Chinese character, an acronym, a word, a heading.
CJK = "[\u4e00-\u9fff]"
ACRONYM = r"(?U)\b[A-Z][A-Z0-9-]{1,14}\b"
WORD = r"[A-Za-z][A-Za-z0-9-]*"
HEADING = r"\\(?:section|subsection|subsubsection|paragraph|subparagraph)\*?\{"

# Rules of one text, (pattern, replacement) in order.
REWRITES: dict[str, list[tuple[str, str]]] = {
    "cjk_punctuation": [(r"\\([（）【】《》，。；：、])", "$1")],
    "item_space": [(r"\\item(?![A-Za-z@])(?=\S)", r"\\item ")],
    "linebreak_dimensions": [(r"(?<!\\)\\\[(\s*\d+(?:\.\d+)?(?:pt|em|ex|mm|cm|in)\s*)\]", r"\\\\[$1]")],
    "section_phrases": [(r"\\S所示[。.]?\s*\\ref\{([^}]+)\}", r"\\S\\ref{$1}所示")],
    "double_escaped_references": [(r"\\\\((?:Cref|cref|ref|eqref|pageref|nameref|cite|citep|citet|citealp|citealt|citeauthor|citeyear))\{", r"\\$1{")],
    "control_word_boundaries": [(rf"\\([A-Za-z@]+)(?={CJK})", r"\\$1{}")],
    "caption_prefixes": [(r"(?m)^Figure\s+(\d+)\s*\|", "图$1 |"), (r"(?m)^Table\s+(\d+)\s*\|", "表$1 |")],
    "text_symbols": [(r"\\(textless|textgreater|textbar)(?!\{\})", r"\\$1{}")],
    "math_fonts": [(r"\\mathbf\s*\{\s*(\\(?:bar|hat|tilde|vec|dot|ddot)\s*\{\s*[^{}]+?\s*\})\s*\}", "$1")],
    "reference_brackets": [(r"(\\section\{[^}]*参考文献[^}]*\}\\label\{references\})\[(\d{1,3})\]", "$1\n{[}$2{]}"), (r"(?m)^(\s*)\[(\d{1,3})\]", "$1{[}$2{]}")],
    "markdown_emphasis": [(r"(?<!\\)\*\*([^\n*][^\n]*?[^\n*])(?<!\\)\*\*", "$1"), (r"(?<!\\)__([^\n_][^\n]*?[^\n_])(?<!\\)__", "$1"), (r"(?<!`)`([^`\n]+)`(?!`)", "$1")],
    "missing_list_items": [(r"(?s)(\\begin\{(itemize|enumerate)\}(?:\[[^\]]*\])?\s*)(?=[^\s\\])((?:(?!\\end\{\2\}).)*)(\\end\{\2\})", r"$1\\item $3$4")],
}

# Within the braces of a key (or of any command's argument) a match goes on where the one before ended.
REWRITES["reference_keys"] = [(rf"((?:{REFERENCE_START}(?=[^{{}}]*\}})|(?!\A)\G)[^{{}}]*?)\\_", "$1_")]
REWRITES["argument_punctuation"] = [(rf"((?:\\[a-zA-Z]{{2,20}}\{{(?=[^}}]*\}})|(?!\A)\G)[^}}]*?){wide}", rf"$1{plain}") for wide, plain in (("：", ":"), ("，", ","))]
REWRITES["pdf_output"] = [(r"\A((?s:.*?))(?dm:^)[ \t]*\\pdfoutput[ \t]*=[ \t]*1[ \t]*(?:%[^\n]*)?\n?", "$1")]
REWRITES["font_classes"] = [(r"(?dm)^[ \t]*\\usepackage(?:\[[^\]]*\])?\{ucharclasses\}[ \t]*\n", "")]
REWRITES["jobname_probe"] = [
    (
        r"(?s)\{\s*\\catcode/=0\s+\\catcode\\\\=12/gdef/mkillslash\\#1\{#1\}\}\s*\\edef\\jobnametmp\{\\expandafter\\string\\csname\s+([^{}\\]+?)\s*\\endcsname\}\s*\\edef\\jobnameapx\{\\expandafter\\mkillslash\\jobnametmp\}",
        r"\\edef\\jobnameapx{$1}",
    )
]
# Characters that break fonts, and what stands for them; control characters that go.
ARROWS = {"→": r"\ensuremath{\rightarrow}", "←": r"\ensuremath{\leftarrow}", "⇒": r"\ensuremath{\Rightarrow}", "⇐": r"\ensuremath{\Leftarrow}"}
RADICALS = {"｜": "|", "⻄": "西", "⻅": "见", "⻔": "门", "⻛": "风", "⻩": "黄"}
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
# Front matter that is translated by rule.
FRONT_MATTER_TEXTS = {
    "*: Core contributors ‡: Project lead": "*: 核心贡献者 ‡: 项目负责人",
    "*: Core contributors  ‡: Project lead": "*: 核心贡献者 ‡: 项目负责人",
}
# Words of a main file that speak for and against it.
MAIN_WORDS = ("\\input", "\\include", "\\ref", "\\cite")
TEMPLATE_WORDS = ("\\LaTeX", "manuscript", "Guidelines", "font", "citations", "rejected", "blind review", "reviewers")
# What stands for names of visual marks.
VISUAL_MARKS = {"参考": "ref", "盒子": "box", "框": "box", "点": "point"}
# The title under which a bibliography stands.
BIBLIOGRAPHY = r"\section*{参考文献}"

# Faults that patterns find, (kind, severity, pattern).
FAULTS = (
    ("prompt_leak", "error", "(?i)(以下为翻译后的\\s*LaTeX\\s*文本|以下为翻译后的文本|Translated LaTeX text|Here is the translated|Here is the translation)"),
    ("bad_reference_key", "error", REFERENCE_START + r"(?:\s*|\.\.\.)\}"),
    ("placeholder_leak", "error", r"(__LATEX_BLOCK_\d+__|\\_\\_LATEX\\_BLOCK\\_\d+\\_\\_)"),
    ("double_escaped_reference", "error", r"\\" + REFERENCE_START),
    ("malformed_reference_command", "error", rf"\\(?:{REFERENCE_COMMANDS})\*?(?:\[[^\]]*\])*\s*" + REFERENCE_START),
    ("latex_control_word_split", "error", r"\\item\s+sep\s*-?\d"),
    ("markdown_artifact", "warn", r"(?<!\\)(?:\*\*[^*\n]+\*\*|__[^_\n]+__|(?<!`)`(?!`)[^`\n]+(?<!`)`(?!`))"),
)
# Lines of a compiler's log that mean failure.
CRITICAL_LOG = r"^!|Fatal|Emergency|Undefined control sequence|LaTeX Error|Missing \$ inserted|Runaway argument|File ended while scanning"
# What is hidden from a translator, in order.
MASKED = (
    r"\\\\(?:\[[^\]]*\])?",
    r"\\textless\s*\|\s*/?\s*(?:ref|box|point)\s*\|\s*\\textgreater",
    r"\|\s*/?\s*(?:ref|box|point)\s*\|\s*\\textgreater",
    r"\\textless\s*\|\s*/?\s*(?:ref|box|point)\s*\|",
    r"(?<!\\)\\\(.+?\\\)",
    r"(?<!\$)\$(?!\$).+?(?<!\$)\$(?!\$)",
    r"\\(?:def|setcounter)\b[^\n]*",
    r"\\tightlist\b",
    r"\\item\b",
    r"\\(?:textless|textbar|textgreater|ldots|par|sloppy|maketitle|noindent)\b(?:\{\})?",
    r"\\(?:begin|end)\{[^}]+\}",
    REFERENCE_FLAT,
    r"\\(?:url|href|includegraphics)\*?(?:\[[^\]]*\])?\{[^}]*\}",
    r"\\[A-Za-z@]+\*?",
)
# Kinds that stop a translation from being finished.
BLOCKING = ("prompt_leak", "bad_reference_key", "placeholder_leak", "double_escaped_reference", "malformed_reference_command", "malformed_reference_key", "latex_section_inside_prose", "missing_list_item", "latex_control_word_split")
# What a report advises for each kind.
ADVICE = {
    "prompt_leak": "删除模型回复前缀，只保留论文正文译文。",
    "bad_reference_key": "恢复原始引用 key，不能保留空引用或省略号引用。",
    "placeholder_leak": "恢复或删除内部占位符，最终 TeX/PDF 不应出现占位符文本。",
    "double_escaped_reference": "引用命令不应被写成双反斜杠；应恢复为单个反斜杠。",
    "malformed_reference_command": "引用命令被重复拼接；应保留一个引用命令并恢复正确 key。",
    "malformed_reference_key": "引用 key 中不应包含正文、嵌套命令或换行；应恢复原始引用 key。",
    "latex_control_word_split": "LaTeX 控制词被拆开；应恢复为 \\itemsep。",
    "markdown_artifact": "清理 Markdown 标记，必要时改用原 LaTeX 强调命令。",
    "latex_section_inside_prose": "检查是否把章节命令误插入正文；正文中的章节引用应使用 \\ref 或自然语言。",
    "english_residue": "人工复查该句是否残留英文连接词、说明短语或未翻译正文。",
    "missing_list_item": "列表环境中的每个条目必须以 \\item 开头；模型修稿时应恢复被删除的 \\item。",
    "likely_untranslated_segment": "该 segment 疑似英文残留过多；模型二次审阅时应对照原文重译。",
}
# The report's fixed lines.
REPORT_TITLE = "# 中文译稿质量审阅清单"
REPORT_CLEAN = "No obvious machine-detectable issues were found. The model should still review the PDF visually."
