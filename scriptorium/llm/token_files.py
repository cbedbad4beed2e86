"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with control bytes apart.

A block holds whole documents: a header, the documents' ids and lengths, the table from rank to token id (most
frequent first, so that frequent ids take one byte), the control bytes (two bits a value: its bytes less one) and the
data bytes. Each block carries its own table, so that blocks are written in one pass and read alone. Blocks travel in
Parquet files, which any store that Spark knows can take and whose committer leaves no half-written file behind a lost
executor. Ids must be below 2**24.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import TOKEN_ROWS, batch, bound_batches, texts_of, tidy

MAGIC = b"RVB1"
BLOCK_IDS = 1_000_000
_HEAD = struct.Struct("<4sIQI")
#: Of each control byte: the bytes of its four values.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block of documents and their token ids."""
    lengths = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    counts = np.bincount(flat) if len(flat) else np.zeros(0, np.int64)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    values = rank[flat] if len(flat) else flat
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF)
    at = np.cumsum(extra + np.int64(1)) - extra - 1
    data = np.empty(int(len(values) + extra.sum()), np.uint8)
    data[at] = values & 0xFF
    for k in (1, 2):
        more = extra >= k
        data[at[more] + k] = (values[more] >> (8 * k)) & 0xFF
    control = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    control[: len(values)] = extra
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    null = np.packbits(np.array([x is None for x in doc_ids], bool)).tobytes()
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(values), len(table)), null, names, lengths.tobytes(), table.tobytes(), control.tobytes(), data.tobytes()])


def decode_block(payload: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a block: id and token ids (uint32, little-endian)."""
    magic, n_docs, n, n_table = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    null = np.unpackbits(take("u1", -(-n_docs // 8)), count=n_docs)
    names, lengths, table = take("<i8", n_docs), take("<u4", n_docs), take("<u4", n_table)
    size = _LENGTHS[take("u1", -(-n // 4))].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.frombuffer(payload, np.uint8, offset=at)
    values = data[start].astype(np.uint32)
    for k in (1, 2):
        more = np.flatnonzero(size > k)
        values[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    ids = table[values] if n else np.zeros(0, "<u4")
    ends = np.cumsum(lengths, dtype=np.int64)
    for name, missing, end, length in zip(names.tolist(), null.tolist(), ends.tolist(), lengths.tolist(), strict=True):
        yield None if missing else name, ids[end - length : end]


_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_READ = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, path: str, encoder: Callable[[], Callable], end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode each text of docs (doc_id, text; null text: empty), append end_id, and write blocks in ascending doc_id order below path.

    Rows of equal doc_id follow each other by the hash of their text; rows without an id come first. encoder() is called on
    the executors and must return a function from texts to arrays of ids. One pass and one shuffle, of the texts.
    """
    bound_batches(docs.sparkSession, 2 * TOKEN_ROWS)

    def blocks(batches):
        encode, shard, number, names, kept, n = encoder(), TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            return batch(_BLOCKS, [[shard], [number], [len(names)], [n], [encode_block(names, kept)]])

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                names.append(name)
                kept.append(np.append(ids, np.uint32(end_id)))
                if (n := n + len(kept[-1])) >= block_ids:
                    yield block()
                    number, names, kept, n = number + 1, [], [], 0
        if names:
            yield block()

    ordered = texts_of(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(tidy(blocks), "shard int, block int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Of each document in the files below path: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from decoded blocks."""
    bound_batches(spark)
    stored = spark.read.parquet(path)

    def documents(batches):
        for b in batches:
            for shard, number, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, at = [], 0
                for name, ids in decode_block(payload):
                    rows.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield batch(_READ, [[shard] * len(rows), [number] * len(rows), *zip(*rows, strict=True)])

    found = stored.select("shard", "block", "payload").mapInArrow(tidy(documents), "shard int, block int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    blocks = stored.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_start")).join(shards, "shard")
    return found.join(blocks, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
