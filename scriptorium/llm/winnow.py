"""Document fingerprints by winnowing: in each window of rolling k-gram hashes the least, the rightmost of equal ones, with its position.

Two texts that share a run of at least WINDOW + GRAM - 1 code points share a fingerprint there: 31 code points by default.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import batch, bound_batches, texts_of, tidy

GRAM = 16
WINDOW = 16
#: The base of the rolling hash and the multiplier that mixes it, both odd.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each run of gram code points; of all of them if they are fewer."""
    h = codes.astype(np.uint64) + np.uint64(1)
    gram, out, have = min(gram, len(h)), h, 1
    while have < gram:  # runs twice as long each time; the last step joins runs that overlap into one of just gram
        step = min(have, gram - have)
        out = out[:-step] * np.uint64(pow(BASE, have, 1 << 64)) + out[step:]
        have += step
    with np.errstate(over="ignore"):
        out = out * np.uint64(MIX)
    return out ^ (out >> np.uint64(32))


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the fingerprints, by position. An empty text has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    h = gram_hashes(codes, gram)
    low = np.uint64(0xFFFFFFFF)
    keys = (h & low) << np.uint64(32) | (low - np.arange(len(h), dtype=np.uint64))  # the rightmost of equal hashes is least
    have, window = 1, min(window, len(keys))
    while have < window:
        step = min(have, window - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    chosen = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (low - (chosen & low)).astype(np.uint32)


def fingerprint_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """hash:position in hexadecimal and decimal, joined by commas."""
    return ",".join([f"{h:x}:{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' hashes; two without any are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def edited(text: str, following: str) -> str:
    """text, its last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cuts(docs: DataFrame, n: int) -> list[int]:
    """At most n ids of docs, descending from the largest, that split its rows about evenly."""
    found = docs.approxQuantile("doc_id", [k / n for k in range(1, n + 1)], 0.2 / n)
    top = docs.agg(F.max("doc_id")).first()[0]
    return sorted({int(x) for x in found} | ({top} if top is not None else set()), reverse=True)


def fingerprint_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, runs: int | None = None) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text; null text: empty) and of its edited text, and their likeness to the next document's.

    Next is the next lower doc_id (of equal ids: by hash of text, descending; rows without an id come last), after the last the first. docs is dealt
    once, into runs of ids that end at known ids; the document that opens a run goes to the run before it too, so no task
    waits for another. Without any id, or with one document, the next document is the document itself.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = runs or int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"))
    cuts = _cuts(ids, n)
    if not cuts:
        return spark.createDataFrame([], _DDL)

    @F.pandas_udf("array<int>")
    def runs_of(ids: pd.Series) -> pd.Series:
        """The run of an id, and the run before if the id opens its run."""
        own = np.searchsorted(rising, ids.to_numpy(), side="left")
        run = last - own
        opens = rising[np.minimum(own, last)] == ids.to_numpy()
        return pd.Series([[r, (r - 1) % (last + 1)] if o else [r] for r, o in zip(run.tolist(), opens.tolist(), strict=True)])

    rising, last = np.array(sorted(cuts), dtype=np.int64), len(cuts) - 1
    texts = texts_of(docs).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    dealt = texts.withColumn("runs", runs_of("key")).select("doc_id", "text", "key", "tie", F.posexplode("runs").alias("guard", "run"))
    dealt = dealt.repartition("run").sortWithinPartitions("run", "guard", F.desc("key"), F.desc("tie"))

    def fingerprints(batches):
        rows, held, run = [], None, None

        def emit(text, own, following, theirs, name):
            changed = edited(text, following)
            new = winnow(changed, gram, window) if changed != text else own
            rows.append((name, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_string(*own), fingerprint_string(*new), likeness(own[0], new[0]), likeness(own[0], theirs[0])))

        closed = None
        for b in batches:
            for name, text, guard, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != run:
                    run, held, closed = at, None, False
                if closed:
                    continue  # more rows of the id that opens the next run
                own = winnow(text, gram, window)
                if held is not None:
                    emit(held[1], held[2], text, own, held[0])
                held, closed = (name, text, own), bool(guard)
            if rows:
                yield batch(_OUT, [*zip(*rows, strict=True)])
                rows = []

    return dealt.select("doc_id", "text", "guard", "run").mapInArrow(tidy(fingerprints), _DDL)
