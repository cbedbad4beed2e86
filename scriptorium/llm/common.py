"""Scratch tables, Arrow batch limits and the cached sub-word encoders that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import string
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship

#: What [^\x20\x09-\x0D] leaves out: the only characters that separate words here.
BLANKS = " \t\n\r\x0b\x0c"

#: Rows and bytes of one Arrow batch, so that a worker's memory doesn't follow the length of the texts.
BATCH_ROWS = 512
#: Rows where a batch's distinct units are looked up together.
TOKEN_ROWS = 2048
BATCH_BYTES = "16m"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small in this session, so that a batch of long texts stays within a worker's memory; send this package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables between stages: spark.checkpoint.dir, or a new local folder where that is unset (tests)."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below scratch_dir(); Hadoop deletes it when the driver's JVM ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/scriptorium/{label}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither compute it again nor depend on lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named; whatever else the table has is left behind."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def held_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def release() -> None:
    """Give a worker's free memory back."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function: Callable) -> Callable:
    """function for mapInArrow; after a partition its worker gives free memory back, as idle workers stay beside busy ones."""

    def wrapped(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return wrapped


def slabs(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have ``most`` bytes together, or one longer text, so that a worker's memory doesn't follow the batch."""
    ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield b.slice(at, to - at)
        at = to


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Of each byte of UTF-8: 1 blank, 2 letter (or part of one from U+00C0 to U+023F), 3 punctuation, 4 what makes a text odd, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS.encode())] = 1
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = 2
_KIND[list(string.punctuation.encode())] = 3
_KIND[[*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC9, 0x100)]] = 4


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in the joined UTF-8 of texts that begin at starts.

    A unit begins with the blanks before a word, and with punctuation after a letter: there every tokenizer of this package
    has a boundary, whatever stands around. A text with characters beyond (other scripts, other blanks, odd signs) is one unit.
    """
    kind = _KIND[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] == 1) & (kind[:-1] != 1) | (kind[1:] == 3) & (kind[:-1] == 2)
    odd = kind == 4
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs for times and division
    odd[1:] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)  # I with a dot: in lower case it ends in a combining mark
    if odd.any():
        ends = np.append(starts[1:], len(data))
        for k in np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1).tolist():
            begins[starts[k] : ends[k]] = False
    begins[starts[starts < len(data)]] = True
    return np.flatnonzero(begins)


class UnitCache:
    """Sub-word ids of whole texts from the ids of their units, each encoded once while it stays in a bounded table.

    ids must be below 65,536. ``encode`` gives the ids of new units as bytes, two little-endian ones each. The table has
    two generations of ``limit`` units: when the young one is full it takes the old one's place, and units still in use return
    from there. ``fold`` lower-cases A-Z first, for tokenizers that do so.
    """

    LONGEST = 64

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], fold: bool = False, limit: int = 150_000):
        self.encode, self.fold, self.limit, self.young, self.old = encode, fold, limit, {}, {}

    def __call__(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        """The ids (uint32, little-endian) of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return []
        _, ends, raw = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        starts = (ends[:-1] - ends[0]).astype(np.int64)
        if self.fold:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        begins = unit_starts(data, starts)
        places = np.append(begins, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids = pa.array(self._look_up(units.dictionary.to_pylist()), pa.binary()).take(units.indices)
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u2") if len(ids) else np.zeros(0, "<u2")
        at = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 2 if len(ids) else np.zeros(1, np.int32)
        cuts = at[np.searchsorted(begins, np.append(starts, len(data)))].tolist()
        return [flat[a:b].astype("<u4") for a, b in zip(cuts, cuts[1:], strict=False)]

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        found = list(map(self.young.get, units))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        if not lacking:
            return found
        old, new = self.old.get, []
        for k in lacking:
            if (ids := old(units[k])) is None:
                new.append(k)
            else:
                found[k] = ids
        for k, ids in zip(new, self.encode([units[k].decode("utf-8", "surrogatepass") for k in new]), strict=True):
            found[k] = ids
        if len(self.young) + len(lacking) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((units[k], found[k]) for k in lacking if len(units[k]) <= self.LONGEST)
        return found


def two_bytes(idss: Iterable[list[int]]) -> Iterator[bytes]:
    return (array("H", ids).tobytes() for ids in idss)


def _json_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


#: Between units that are encoded in one call: blanks and a control character that stands in no such unit.
_BETWEEN = "\n\x01\n"
_PLAIN = re.compile(f" ?[^{BLANKS}\x01]{{1,64}}").fullmatch


class _JoinedEncoder:
    """Ids of units from few calls: plain ones go in one text, and the known ids of the mark between them part them again."""

    def __init__(self, path: str):
        found = _json_tokenizer(path)
        self.encode = lambda texts: [e.ids for e in found.encode_batch_fast(texts, add_special_tokens=False)]
        one, marked, blank = self.encode(["a", f"a{_BETWEEN}a", "a\na"])
        mark = marked[len(one) : -len(one)]
        self.size = len(mark)
        self.at, self.id = next((k, i) for k, i in enumerate(mark) if i not in blank)

    def __call__(self, units: list[str]) -> Iterator[bytes]:
        plain = list(map(_PLAIN, units))
        other = two_bytes(self.encode([u for u, p in zip(units, plain, strict=True) if not p]))
        ids = np.array(self.encode([_BETWEEN.join(u for u, p in zip(units, plain, strict=True) if p)])[0], "<u2")
        mark = np.flatnonzero(ids == self.id) - self.at
        start, end = np.append(0, mark + self.size) * 2, np.append(mark, len(ids)) * 2
        raw = ids.tobytes()
        parts = map(raw.__getitem__, map(slice, start.tolist(), end.tolist()))
        return (next(parts) if p else next(other) for p in plain)


_OPEN: dict = {}


def json_encoder(path: str, fold: bool, limit: int = 150_000) -> UnitCache:
    """Cached encoder over a file of the tokenizers library; one for each worker process. fold: the tokenizer lower-cases."""
    if (path, fold) not in _OPEN:
        _OPEN[path, fold] = UnitCache(_JoinedEncoder(path), fold, limit)
    return _OPEN[path, fold]
