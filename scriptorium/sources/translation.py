"""Translation by a model: what it is asked, how its replies are read, and when it is asked again.

A Backend is any function from a list of prompts to a list of replies. It runs on the workers, a batch at a time.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import patterns as P
from scriptorium.functions import scanners
from scriptorium.operators import glossary
from scriptorium.session import ship

Backend = Callable[[list[str]], list[str]]

_CJK = re.compile(P.CJK)
_RULES = "Leave LaTeX commands, keys, equations and environments as they are, and every __LATEX_BLOCK_0000__ token too. Use no Markdown. Answer with the text only."
_AGAIN = "The previous attempt left too much English. Translate the prose into idiomatic Chinese while preserving LaTeX exactly, especially reference and citation command keys."


# --- replies ---


def unfenced(reply: str) -> str:
    """A reply without the code fence around it."""
    reply = reply.strip()
    if not reply.startswith("```"):
        return reply
    _, _, body = reply.partition("\n")
    return re.sub(r"(?:\A|\n)[ \t]*```[ \t]*\Z", "", body).strip()


def without_echo(original: str, reply: str) -> str:
    """A reply after the source text it begins with, if eight Chinese characters follow."""
    original, reply = original.strip(), reply.strip()
    at = reply.find(original) if original else -1
    rest = reply[at + len(original) :].lstrip(" \n\r\t:：-") if 0 <= at <= 24 else ""
    return rest if len(_CJK.findall(rest)) >= 8 else reply


def left_english(original: str, translated: str) -> bool:
    """As functions.untranslated, for texts that are on a worker already."""
    a, b = " ".join(original.split()), " ".join(translated.split())
    if len(a) >= 80 and len(b) > len(a) + 8 and 0 <= b.find(a) <= 24:
        return True
    known = re.search(r"\\(?:author|email|affiliation|institution|orcid|city|country)\{", original) and original.count("\\") >= 2
    n = len(_CJK.findall(translated))
    t = translated.strip()
    if known or t.startswith("[") and n < 8 and re.search(r"\b[A-Za-z][A-Za-z-]*\s*=", t):
        return False
    letters = sum(c.isascii() and c.isalpha() for c in original)
    return letters >= 80 and n < max(8, letters // 80)


# --- asking ---


def ask(texts: list[str], backend: Backend, requirement: str = "", terms: list[str] | None = None) -> list[str]:
    """Translations of texts: blocks hidden, asked, unfenced, blocks back, without an echo of the source."""
    hidden = [scanners.mask(t) for t in texts]
    style = f"Style: {requirement.strip()}\n" if requirement.strip() else ""
    known = [f"{x}\n" if x else "" for x in (terms or [""] * len(texts))]
    prompts = [f"Translate this section of an English academic paper into Chinese. {_RULES}\n{style}{k}\n{masked}" for k, (masked, _) in zip(known, hidden, strict=True)]
    return [without_echo(t, scanners.unmask(unfenced(r or ""), blocks)) for t, (_, blocks), r in zip(texts, hidden, backend(prompts), strict=True)]


def ask_again(texts: list[str], backend: Backend, requirement: str = "", terms: list[str] | None = None, retries: int = 4) -> tuple[list[str], list[int], list[bool]]:
    """Translations, attempts, and whether they still look untranslated, after asking again for those that do, ``retries`` times at most."""
    terms = terms or [""] * len(texts)
    out, tries = ask(texts, backend, requirement, terms), [1] * len(texts)
    for _ in range(retries):
        bad = [k for k, t in enumerate(texts) if left_english(t, out[k])]
        if not bad:
            break
        for k, said in zip(bad, ask([texts[k] for k in bad], backend, f"{requirement}\n{_AGAIN}".strip(), [terms[k] for k in bad]), strict=True):
            out[k], tries[k] = said, tries[k] + 1
    return out, tries, [left_english(t, x) for t, x in zip(texts, out, strict=True)]


def translated(pending: DataFrame, backend: Backend, requirement: str = "", retries: int = 4, model: str = "") -> DataFrame:
    """doc_id, id, translation, model, attempts, suspicious of pending (doc_id, id, text; terms, a prompt's lines, may be there).

    Empty replies are left out, so that their segments stay pending.
    """
    ship(pending.sparkSession)
    rows = pending.select("doc_id", "id", F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("terms", F.lit("")) if "terms" in pending.columns else F.lit("")).alias("terms"))

    def asked(batches):
        for b in batches:
            said, tries, bad = ask_again(b["text"].tolist(), backend, requirement, b["terms"].tolist(), retries)
            yield b[["doc_id", "id"]].assign(translation=said, model=model, attempts=tries, suspicious=bad)

    doc_id = pending.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(asked, f"doc_id {doc_id}, id string, translation string, model string, attempts int, suspicious boolean").filter("translation != ''")


def revised(flags: DataFrame, segments: DataFrame, backend: Backend, requirement: str = "", most: int = 2) -> DataFrame:
    """doc_id, id, revised, attempts: translations of review.flagged() rows, asked for again with the terms they lack until none is missing.

    Each reply is repaired against the original (scanners.fix) before it is looked at; ``most`` replies at most.
    """
    ship(flags.sparkSession)
    line = F.transform("matched_terms", lambda t: F.concat(F.lit("- "), t["source"], F.lit(" -> "), t["translation"]))
    rows = flags.join(segments.select("doc_id", "id", "text"), ["doc_id", "id"]).select("doc_id", "id", "text", "translated", F.array_join(line, "\n").alias("lines"), F.transform("matched_terms", lambda t: t["translation"]).alias("wanted"))

    def one(text: str, current: str, lines: str, wanted: list[str]) -> tuple[str, int]:
        masked, blocks = scanners.mask(text)
        lacking = [w for w in wanted if w and w not in current]
        tries = 0
        while lacking and tries < most:
            hidden = current
            for token, block in blocks:
                hidden = hidden.replace(block, token)
            extra = f"The last revision still lacks: {', '.join(lacking)}.\n" if tries else ""
            prompt = f"Revise a Chinese translation so that it uses these terms. {_RULES}\n{requirement}\n{extra}{glossary.PROMPT_HEAD}\n{lines}\n\nOriginal:\n{masked}\n\nTranslation:\n{hidden}"
            reply = without_echo(text, scanners.unmask(unfenced(backend([prompt])[0] or ""), blocks))
            current, tries = scanners.fix(reply, text), tries + 1
            lacking = [w for w in wanted if w and w not in current]
        return current, tries

    def asked(batches):
        for b in batches:
            made = [one(*x) for x in zip(b["text"], b["translated"], b["lines"], b["wanted"], strict=True)]
            yield b[["doc_id", "id"]].assign(revised=[x for x, _ in made], attempts=[n for _, n in made])

    return rows.mapInPandas(asked, f"doc_id {flags.schema['doc_id'].dataType.simpleString()}, id string, revised string, attempts int")


def glossary_replies(candidates: DataFrame, backend: Backend, most: int = 40, requirement: str = "") -> DataFrame:
    """doc_id, reply: what a model makes of each document's candidates (doc_id, rank, source, count, kind, contexts); read it with glossary.normalized().

    A reply that isn't JSON is asked for again, three times in all.
    """
    ship(candidates.sparkSession)
    one = F.struct("source", "count", "kind", "contexts")
    rows = candidates.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("c")))), lambda x: x["c"])).alias("data"))
    shape = '{"terms": [{"source": str, "translation": str, "type": "term|abbreviation", "aliases": [str], "note": str}]}'
    head = f"Choose the terms and abbreviations of this article that must be translated alike throughout, {most} at most, close variants as aliases. Return JSON only, as {shape}.\n{requirement}\n"

    def is_json(reply: str) -> bool:
        try:
            return isinstance(json.loads(reply), dict | list)
        except ValueError:
            return False

    def asked(batches):
        for b in batches:
            out = [""] * len(b)
            for _ in range(3):
                bad = [k for k, x in enumerate(out) if not is_json(x)]
                if bad:
                    for k, reply in zip(bad, backend([head + b["data"].iat[k] for k in bad]), strict=True):
                        out[k] = unfenced(reply or "")
            yield b[["doc_id"]].assign(reply=out)

    return rows.mapInPandas(asked, f"doc_id {candidates.schema['doc_id'].dataType.simpleString()}, reply string")


# The prompts that are written for use outside.
_WRITTEN = (
    "Translate the following English academic LaTeX segment into Chinese. "
    "Do not modify LaTeX commands, citation keys, labels, equations, begin/end environments, file names, or braces. "
    "Keep reference and citation commands byte-for-byte unchanged, including \\Cref{...}, \\cref{...}, \\ref{...}, \\eqref{...}, \\pageref{...}, \\nameref{...}, \\cite{...}, \\citep{...}, \\citet{...}; never escape underscores inside their braces. "
    "Do not use Markdown syntax such as **bold**, __bold__, `code`, headings, or bullet lists. "
    "Return only the translated segment."
)


def written_prompts(segments: DataFrame, requirement: str = "") -> DataFrame:
    """doc_id, id, system, prompt, original of segments (doc_id, id, text)."""
    rule = f"\nAdditional glossary or style rule: {requirement.strip()}" if requirement else ""
    text: Column = F.concat(F.lit(f"{_WRITTEN}{rule}\n\n"), "text")
    return segments.select("doc_id", "id", F.lit("You are a professional academic paper translator.").alias("system"), text.alias("prompt"), F.col("text").alias("original"))


# --- a model behind HTTP ---


@dataclass
class ChatBackend:
    """A chat model at an address that takes OpenAI's form; post may be replaced. Busy servers are asked again, ``tries`` times in all."""

    base_url: str
    model: str
    key: str = field(repr=False)
    timeout: int = 120
    tries: int = 8
    temperature: float = 0.1
    system: str = "You are a professional academic LaTeX translator. Return valid LaTeX text, not Markdown."
    post: Callable[[str, dict, dict, int], tuple[int, bytes]] | None = None
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}], "temperature": self.temperature, "stream": False}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        last = ""
        for turn in range(1, self.tries + 1):
            try:
                status, data = (self.post or _post)(f"{self.base_url.rstrip('/')}/chat/completions", headers, body, self.timeout)
                if status == 200:
                    return (json.loads(data)["choices"][0]["message"].get("content") or "").strip()
                last = f"HTTP {status}"
            except (OSError, ValueError, LookupError) as e:
                last = type(e).__name__
            if turn < self.tries:
                self.sleep(min(30, 2 * turn))
        raise RuntimeError(f"the model didn't answer in {self.tries} attempts: {last}")


def _post(url: str, headers: dict, body: dict, timeout: int) -> tuple[int, bytes]:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return reply.status, reply.read()


def translate(pending: DataFrame, backend: Backend) -> DataFrame:
    """pending (doc_id, id, text) with translation as backend gives it for each text alone: no prompt, no repair. Empty ones stay pending."""
    ship(pending.sparkSession)

    def rows(batches):
        for b in batches:
            yield b[["doc_id", "id"]].assign(translation=backend(b["text"].tolist()))

    schema = f"doc_id {pending.schema['doc_id'].dataType.simpleString()}, id string, translation string"
    return pending.select("doc_id", "id", "text").mapInPandas(rows, schema).filter("translation != ''")

