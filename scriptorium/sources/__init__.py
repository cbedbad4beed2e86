"""Readers and writers: TeX projects, JSON lines, archives; addresses of sources."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import patterns as P
from scriptorium.functions import arxiv_id, html_escaped, plain_title, scanners, strip, strip_comments
from scriptorium.session import ship


def read_tex(spark: SparkSession, path: str) -> DataFrame:
    """All .tex files below path: doc_id (the folder below path), path, content."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(F.substring_index(at, path.rstrip("/") + "/", -1), r"^([^/]+)/", 1).alias("doc_id"), at.alias("path"), F.col("value").alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).write.mode("overwrite").json(path)


def source_urls(url):
    """Addresses of an arXiv article's source, in the order to try; null for other addresses."""
    name = arxiv_id(url)
    return F.when(name.isNotNull(), F.array(F.concat(F.lit("https://arxiv.org/src/"), name), F.concat(F.lit("https://arxiv.org/e-print/"), name)))


def pdf_url(url):
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(url), F.lit(".pdf"))


def members(content: bytes, depth: int = 2) -> list[tuple[str, bytes]]:
    """Files in a zip, a tar of any compression, or a gzip of either; a lone TeX text is main.tex. Paths that leave the archive are left out."""
    data = io.BytesIO(content)
    if zipfile.is_zipfile(data):
        with zipfile.ZipFile(data) as z:
            found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    else:
        try:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                found = [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
        except tarfile.TarError:
            if content[:2] == b"\x1f\x8b" and depth:
                return members(gzip.decompress(content), depth - 1)
            found = [("main.tex", content)] if b"\\documentclass" in content or b"\\begin{document}" in content else []
    return [(n, d) for n, d in found if not n.startswith("/") and ".." not in n.split("/")]


def unpack(archives: DataFrame) -> DataFrame:
    """archives (path, content) as read by binaryFile: path, member, content; one archive at a time is in memory."""
    ship(archives.sparkSession)

    def rows(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                if found := members(bytes(content)):
                    yield pd.DataFrame({"path": path, "member": [n for n, _ in found], "content": [d for _, d in found]})

    return archives.select("path", "content").mapInPandas(rows, "path string, member string, content binary")


def main_files(tex: DataFrame) -> DataFrame:
    """doc_id, path of each project's main file: with a document class; of several the one that includes most and looks least like a template, then longest."""
    has = lambda words: sum((F.col("plain").contains(w).cast("int") for w in words), F.lit(0))
    rows = tex.filter(F.col("content").contains("\\documentclass") & ~F.regexp_extract("path", r"([^/]*)$", 1).startswith("merge")).withColumn("plain", strip_comments(F.col("content")))
    score = has(P.MAIN_WORDS) - has(P.TEMPLATE_WORDS)
    return rows.groupBy("doc_id").agg(F.max_by("path", F.struct(score.alias("score"), F.length("plain").alias("n"), F.col("path").alias("path"))).alias("path"))


_CALL = re.compile(r"\\(?:input|include)\{([^}]+)\}")


def expanded(files: dict[str, str], main: str, root: str) -> str:
    """The main file of a project (path: text without comments) with its includes in place, each file once; missing ones leave a comment.

    A name is looked for in the folder of the file that names it, then in the project's, with the suffix .tex; in either whatever its case.
    """
    folded: dict[str, str] = {}
    for path in sorted(files, reverse=True):
        folded[posixpath.join(posixpath.dirname(path), posixpath.basename(path).lower())] = path
    seen: set[str] = set()

    def found(folder: str, name: str) -> str | None:
        path = posixpath.normpath(posixpath.join(folder, name))
        if not name.lower().endswith(".tex"):
            path = posixpath.splitext(path)[0] + ".tex"
        near = posixpath.join(folder, posixpath.basename(path).lower())
        return path if path in files else folded.get(near)

    def body(path: str) -> str:
        if path in seen:
            return ""
        seen.add(path)
        parts = _CALL.split(files[path])
        for k in range(1, len(parts), 2):
            name = parts[k]
            inner = found(posixpath.dirname(path), name) or found(root, name)
            call = next(c for c in ("input", "include") if f"\\{c}{{{name}}}" in files[path])
            parts[k] = body(inner) if inner else f"\n% missing include: \\{call}{{{name}}}\n"
        return "".join(parts)

    return body(main)


def with_includes(tex: DataFrame) -> DataFrame:
    """doc_id, text: the main file of each project of tex (doc_id, path, content) with \\input and \\include replaced by the files named.

    A project's files are one group: a task holds the sources of one article. A project without a main file gives no row.
    """
    ship(tex.sparkSession)
    mains = main_files(tex).withColumnRenamed("path", "main")
    rows = tex.join(mains, "doc_id").select("doc_id", "path", "main", strip_comments(F.col("content")).alias("body"))

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        split = lambda path: path.partition("://")[2] or path.removeprefix("file:")
        names = [posixpath.normpath(split(x)) for x in part["path"]]
        name, folder = part["doc_id"].iat[0], posixpath.commonpath([posixpath.dirname(x) for x in names])
        at = f"{folder}/".find(f"/{name}/")
        root = folder[: at + len(str(name)) + 1] if at >= 0 else folder
        text = expanded(dict(zip(names, part["body"], strict=True)), posixpath.normpath(split(part["main"].iat[0])), root)
        return pd.DataFrame({"doc_id": [name], "text": [text]})

    return rows.groupBy("doc_id").applyInPandas(whole, f"doc_id {tex.schema['doc_id'].dataType.simpleString()}, text string")


def title_of(tex: DataFrame) -> DataFrame:
    """doc_id, title of each project in plain words; null if it names none. A project without a main file is read from its first file."""
    ship(tex.sparkSession)
    first = tex.groupBy("doc_id").agg(F.min_by("content", "path").alias("first"))
    rows = first.join(with_includes(tex), "doc_id", "left").select("doc_id", F.coalesce("text", "first").alias("text"))
    return rows.select("doc_id", F.nullif(plain_title(scanners.argument_of(F.col("text"), "title")), F.lit("")).alias("title"))


# The article that a text without markup becomes.
_ARTICLE = (
    "\\documentclass{article}\n\\usepackage{geometry}\n\\geometry{margin=1in}\n\\title{",
    "}\n\\author{}\n\\date{}\n\\begin{document}\n\\maketitle\n\\sloppy\n",
    "\n\\end{document}\n",
)


def article_of(texts: DataFrame) -> DataFrame:
    """doc_id, text: plain texts (doc_id, text, name) as articles. The first paragraph is the title, the name where there is none."""
    ship(texts.sparkSession)
    parts = F.filter(F.transform(F.split(F.replace("text", F.lit("\f"), F.lit("\n\n")), r"\n\s*\n"), strip), lambda x: x != "")
    rows = texts.select("doc_id", F.coalesce(F.get(parts, F.lit(0)), "name").alias("title"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "\n\n").alias("body"))
    ends = F.regexp_replace(F.regexp_replace("escaped", r"\n\n", "\\\\par\n\n"), r"(?s)(.)\z", "$1\\\\par")
    rows = rows.select("doc_id", scanners.latex_text("title").alias("title"), scanners.latex_text("body").alias("escaped"))
    return rows.select("doc_id", F.concat(F.lit(_ARTICLE[0]), "title", F.lit(_ARTICLE[1]), ends, F.lit(_ARTICLE[2])).alias("text"))


def debug_pages(nodes: DataFrame) -> DataFrame:
    """doc_id, html: a document's nodes (doc_id, node, kind, text, segment_id) on one page, segments dark and layout red."""
    style = "white-space:pre-wrap;color:{};border-bottom:1px solid #ddd;padding:8px"
    head = lambda color: F.lit(f"<pre style='{style.format(color)}'>[")
    row = F.concat(F.when(F.col("kind") == "translate", head("#111")).otherwise(head("#a33")), F.coalesce("segment_id", "kind"), F.lit("]\n"), html_escaped(F.col("text")), F.lit("</pre>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", row.alias("row")))), lambda x: x["row"]), "\n")
    return nodes.groupBy("doc_id").agg(F.concat(F.lit("<html><meta charset='utf-8'><body>\n"), rows, F.lit("\n</body></html>")).alias("html"))
