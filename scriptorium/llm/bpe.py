"""Byte-level BPE by overlapping chunks: encoding that spreads one long text over many tasks, and decoding to raw bytes.

A text up to CHUNK characters is one piece. A longer one is cut into chunks that overlap; each chunk is pre-tokenised by
itself, wherever it starts. From the first boundary that two neighbours share in their overlap on, both see the same
pre-tokens, so the text is cut there into pieces that are encoded apart. Neighbours that share none (one pre-token spans
the overlap) form a longer piece together, so ids are exact always.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import TOKEN_ROWS, UnitCache, batch, bound_batches, texts_of, two_bytes, tidy

CHUNK = 32_768
OVERLAP = 512
#: So near to the end of a chunk that goes on elsewhere, what isn't visible can still change a match.
MARGIN = 8


@cache
def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding over a file of ranks; no special tokens. One for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def rank_encoder(path: str, pattern: str) -> UnitCache:
    found = rank_encoding(path, pattern)
    return UnitCache(lambda new: two_bytes(map(found.encode_ordinary, new)))


@cache
def byte_table(path: str, pattern: str) -> list[bytes]:
    """The bytes of each id."""
    found = rank_encoding(path, pattern)
    table = [b""] * found.n_vocab
    for token in found.token_byte_values():
        table[found.encode_single_token(token)] = token
    return table


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def boundaries(text: str, pattern: str, start: int, end: int) -> list[int]:
    """Where pre-tokens of text begin, from start to end, if a character that isn't blank stands before; there a cut changes no pre-token."""
    import regex

    return [m.start() for m in regex.compile(pattern).finditer(text) if start <= m.start() < end and m.start() and not text[m.start() - 1].isspace()]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_CHUNKED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("text", pa.string()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
_DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(names, idss, table):
    rows = [(name, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode_bytes(ids, table)).hexdigest()) for name, ids in zip(names, idss, strict=True)]
    return batch(_DIGEST, [*zip(*rows, strict=True)] if rows else [[]] * 4)


def pieces_of(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The texts of long (doc_id, row, text), cut at resynchronised boundaries: doc_id, row, part, text."""
    n = F.length("text")
    parts = F.expr(f"sequence(0L, cast(greatest(length(text) - 1, 0) div {chunk} as long))")
    cut = long.select("doc_id", "row", "text", n.alias("n"), F.explode(parts).alias("k"))
    cut = cut.select("doc_id", "row", "k", (F.col("k") * chunk).alias("at"), F.expr(f"substring(text, cast(k * {chunk} + 1 as int), {chunk + overlap})").alias("text"))

    def pretokenise(batches):
        for b in batches:
            rows = []
            for name, row, k, at, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = boundaries(text, pattern, 0, len(text))
                rows.append((name, row, k, at, text[:chunk], [at + x for x in found if x < overlap] if k else [], [at + x for x in found if chunk <= x < chunk + overlap - MARGIN]))
            yield batch(_CHUNKED, [*zip(*rows, strict=True)] if rows else [[]] * 7)

    seen = cut.repartition("doc_id", "row", "k").mapInArrow(tidy(pretokenise), "doc_id long, row long, k long, at long, text string, head array<long>, tail array<long>")
    order = Window.partitionBy("doc_id", "row").orderBy("k")
    # A chunk's boundaries hold from the point where it met its predecessor on, if the predecessor's hold. After a chunk that
    # met none nothing is certain, so the rest of that text stays in one piece.
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    seen = seen.withColumn("met", F.when(F.col("k") == 0, F.lit(0)).otherwise(met))
    certain = F.min(F.col("met").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sure = seen.withColumn("sync", F.when(certain, F.col("met")))
    # The part before the meeting point belongs to the piece before.
    halves = F.array(
        F.struct((F.col("at")).alias("from"), F.expr("if(sync is null, text, substring(text, 1, cast(sync - at as int)))").alias("text"), F.lit(False).alias("opens")),
        F.struct(F.col("sync").alias("from"), F.expr("if(sync is null, '', substring(text, cast(sync - at + 1 as int)))").alias("text"), F.col("sync").isNotNull().alias("opens")),
    )
    laid = sure.select("doc_id", "row", F.explode(halves).alias("h")).select("doc_id", "row", "h.*").filter("from is not null and (opens or text != '')")
    part = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("doc_id", "row").orderBy("from", "opens").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("part", part)
    joined = F.expr("array_join(transform(array_sort(collect_list(struct(from, opens, text))), x -> x.text), '')")
    return laid.groupBy("doc_id", "row", "part").agg(joined.alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs (doc_id, text; null text: empty): doc_id, n_tokens, ids_sha256, decoded_sha256. Rows of equal doc_id stay apart."""
    bound_batches(docs.sparkSession, TOKEN_ROWS)
    texts = texts_of(docs)
    short, long = texts.filter(F.length("text") <= chunk), texts.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())

    def whole(batches):
        encode, table = rank_encoder(path, pattern), byte_table(path, pattern)
        for b in batches:
            yield _digest(b.column(0).to_pylist(), encode(b.column(1)), table)

    def encode_pieces(batches):
        encode = rank_encoder(path, pattern)
        for b in batches:
            yield batch(_ENCODED, [*b.columns[:3], [x.tobytes() for x in encode(b.column(3))]])

    def gather(batches):
        table = byte_table(path, pattern)
        for b in batches:
            yield _digest(b.column(0).to_pylist(), (np.frombuffer(b"".join(x), "<u4") for x in b.column(1).to_pylist()), table)

    pieces = pieces_of(long, pattern, chunk, overlap).mapInArrow(tidy(encode_pieces), "doc_id long, row long, part long, ids binary")
    ordered = F.expr("transform(array_sort(collect_list(struct(part, ids))), x -> x.ids)")
    long = pieces.groupBy("doc_id", "row").agg(ordered.alias("ids")).select("doc_id", "ids").mapInArrow(tidy(gather), _DIGEST_DDL)
    return short.mapInArrow(tidy(whole), _DIGEST_DDL).unionByName(long)
