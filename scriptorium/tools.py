"""Programs on the driver's machine: compilers and PDF tools. ``call`` may be any function of subprocess.run's form."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from collections.abc import Callable
from pathlib import Path

COMPILERS = ("lualatex", "xelatex", "pdflatex")


def installed(which: Callable[[str], str | None] = shutil.which) -> list[str]:
    return [c for c in COMPILERS if which(c)]


def succeeds(command: list[str], folder: Path, seconds: int = 120, call=subprocess.run) -> bool:
    """Whether a program ends well in time."""
    try:
        return call(command, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, timeout=seconds).returncode == 0
    except subprocess.TimeoutExpired:
        return False


def bibliographies(aux: str) -> list[str]:
    """The bibliography files that an .aux file names."""
    return [f"{x.strip()}.bib" for names in re.findall(r"\\bibdata\{([^}]*)\}", aux) for x in names.split(",") if x.strip()]


def compile_once(compiler: str, folder: Path, main: str, seconds: int = 180, call=subprocess.run, which=shutil.which) -> tuple[bool, bool]:
    """Whether a readable PDF came out, and whether all passes ended well: one pass, the bibliography if there is one, two passes."""
    pdf, aux = folder / f"{main}.pdf", folder / f"{main}.aux"
    pdf.unlink(missing_ok=True)
    one_pass = lambda: succeeds([compiler, "-interaction=batchmode", "-file-line-error", f"{main}.tex"], folder, seconds, call)
    good = one_pass()
    if aux.exists() and which("bibtex") and any((folder / b).exists() for b in bibliographies(aux.read_text("utf-8", "ignore"))):
        succeeds(["bibtex", main], folder, seconds, call)
    good = one_pass() and good
    good = one_pass() and good
    return pdf_readable(pdf, call, which), good


def pdf_info(pdf: Path, call=subprocess.run, which=shutil.which) -> str | None:
    if not pdf.is_file() or not which("pdfinfo"):
        return None
    done = call(["pdfinfo", str(pdf)], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)
    return done.stdout if done.returncode == 0 else ""


def pdf_readable(pdf: Path, call=subprocess.run, which=shutil.which) -> bool:
    info = pdf_info(pdf, call, which)
    return pdf.is_file() if info is None else "Pages:" in info


def page_count(info: str | None) -> int | None:
    """The number of pages in what pdfinfo says."""
    m = re.search(r"^Pages:\s+(\d+)\s*$", info or "", re.M)
    return int(m[1]) if m else None


def rendered(pdf: Path, folder: Path, pages: list[int], prefix: str, call=subprocess.run) -> list[Path]:
    """Images of pages, one file each."""
    folder.mkdir(parents=True, exist_ok=True)
    made = [folder / f"{prefix}_page_{n:03d}" for n in pages]
    for n, stem in zip(pages, made, strict=True):
        done = call(["pdftoppm", "-png", "-f", str(n), "-l", str(n), "-singlefile", str(pdf), str(stem)], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)
        if done.returncode or not stem.with_suffix(".png").is_file():
            raise RuntimeError(f"page {n} of {pdf} can't be rendered")
    return [stem.with_suffix(".png") for stem in made]


def review_pack(source: Path, translated: Path, folder: Path, pages: list[int], call=subprocess.run, which=shutil.which) -> Path:
    """Images of the same pages of two PDFs, of those that both have, and a manifest."""
    known = [n for n in (page_count(pdf_info(p, call, which)) for p in (source, translated)) if n is not None]
    pages = [n for n in pages if not known or n <= min(known)]
    if not pages:
        raise ValueError("no such pages")
    shutil.rmtree(folder, ignore_errors=True)
    images = {name: [str(x) for x in rendered(pdf, folder / f"{name}_pages", pages, name, call)] for name, pdf in (("source", source), ("translated", translated))}
    manifest = {"source_pdf": str(source), "translated_pdf": str(translated), "pages": pages, "source_images": images["source"], "translated_images": images["translated"]}
    (folder / "manifest.json").write_text(json.dumps(manifest, ensure_ascii=False, indent=2), "utf-8")
    return folder
