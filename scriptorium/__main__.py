"""The steps from a command line: python -m scriptorium STEP ...; tables between steps are JSON lines below --work."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import config, sources
from scriptorium.operators import flow, quality, segments
from scriptorium.sources import translation

NODES = "doc_id string, node long, kind string, text string, segment_id string"
TRANSLATIONS = "doc_id string, id string, translation string, model string, attempts int, suspicious boolean, ord int"
TERMS = "doc_id string, ord int, source string, translation string, type string, aliases array<string>, note string"


class Work:
    """A work folder's tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def has(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.has(name):
            raise SystemExit(f"{self.folder}/{name} is missing; run the step that makes it first")
        return sources.read_jsonl(self.spark, f"{self.folder}/{name}", schema)

    def write(self, rows: DataFrame, name: str, *order: str) -> DataFrame:
        sources.write_jsonl(rows, f"{self.folder}/{name}", *order)
        return self.spark.read.schema(rows.schema).json(f"{self.folder}/{name}")

    def segments(self) -> DataFrame:
        return self.read("nodes", NODES).filter("segment_id is not null").select("doc_id", F.col("segment_id").alias("id"), "text")


def prepare(work: Work, args, _backend) -> None:
    ready = flow.prepared(sources.read_tex(work.spark, args.project), work.write)
    work.write(sources.debug_pages(ready.nodes), "debug", "doc_id")


def prompts(work: Work, args, _backend) -> None:
    work.write(translation.written_prompts(work.segments(), args.requirement), "prompts", "doc_id", "id")


def glossary(work: Work, args, backend) -> None:
    work.write(flow.terms(work.segments(), backend(), args.terms, args.requirement, work.write), "terms", "doc_id", "ord")


def translate(work: Work, args, backend) -> None:
    done = work.read("translated", TRANSLATIONS) if work.has("translated") and not args.force else None
    known = work.read("terms", TERMS)
    made = flow.translations(work.segments(), known, done, backend(), args.requirement, args.limit, work.write)
    # Written beside first: the table that is replaced is read here.
    work.write(work.write(made, "translated_next", "doc_id", "id"), "translated", "doc_id", "id")


def review(work: Work, args, backend) -> None:
    better, rows = flow.reviewed(work.segments(), work.read("translated", TRANSLATIONS), work.read("terms", TERMS), backend(), args.requirement, work.write)
    work.write(better, "reviewed", "doc_id", "id")
    work.write(rows, "review", "doc_id", "id")


def apply(work: Work, args, _backend) -> None:
    work.write(segments.applied(work.read("nodes", NODES), work.read("reviewed" if work.has("reviewed") else "translated", TRANSLATIONS)), "sources", "doc_id")


def check(work: Work, args, _backend) -> None:
    made = work.read("reviewed" if work.has("reviewed") else "translated", TRANSLATIONS)
    _, found = quality.repaired(work.read("nodes", NODES), made, args.passes, work.write)
    work.write(found.drop("place"), "issues", "doc_id")
    work.write(quality.report_text(found, work.segments()), "report", "doc_id")


def run(work: Work, args, backend) -> None:
    made = flow.run(sources.read_tex(work.spark, args.project), backend(), args.requirement, args.passes, work.write)
    work.write(quality.report_text(made.issues, made.sources), "report", "doc_id")
    work.write(made.summary, "summary", "doc_id")


STEPS: dict[str, Callable] = {f.__name__: f for f in (prepare, prompts, glossary, translate, review, apply, check, run)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scriptorium", description="Translate LaTeX projects at scale.")
    out.add_argument("step", choices=[*STEPS, "config", "paths"])
    out.add_argument("--work", default="work", help="folder of the tables between steps")
    out.add_argument("--project", default=".", help="folder of TeX projects, one folder each")
    out.add_argument("--requirement", default="", help="a rule of style that every prompt has")
    out.add_argument("--terms", type=int, default=40, help="most terms of a glossary")
    out.add_argument("--limit", type=int, help="most segments of a document to translate now")
    out.add_argument("--passes", type=int, default=2, help="most repairs of blocked documents")
    out.add_argument("--force", action="store_true", help="translate again what is translated")
    out.add_argument("--env-file")
    for name in config.MODEL:
        out.add_argument(f"--{name.replace('_', '-')}")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, backend: translation.Backend | None = None) -> int:
    args = parser().parse_args(argv)
    config.load(args.env_file)
    given = {k: getattr(args, k) for k in config.MODEL}
    if args.step == "config":
        print(json.dumps(config.status(**given), indent=2))
    elif args.step == "paths":
        print(json.dumps({"home": str(config.home_dir()), "work": str(Path(args.work).resolve()), "env_files": [str(p) for p in config.candidate_files(args.env_file)]}, indent=2))
    else:
        if spark is None:
            from scriptorium.session import SETTINGS

            spark = SparkSession.builder.config(map=SETTINGS).getOrCreate()
        STEPS[args.step](Work(spark, args.work), args, lambda: backend or translation.ChatBackend(**config.model_settings(**given)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
