"""Language-model scoring: add-one word counts as the base, and a hashed maximum-entropy model with class-factored softmax.

A word's probability is that of its class after the words before it, times its own within the class, after the words before it too:
a class's words are the leaves of a Huffman tree, and each node has a softmax over its children. Classes come from the whole
corpus: every word's count is kept by the group of its document, which is the signs of a few random projections of the document's
words; frequent words spread alike over groups fall into one cluster, and a word's class is its cluster and its band of frequency; rarer words are one class, the end of a text is one. The
class softmax and those of the nodes have n-gram and skip features in hashed rows of weights; every task runs through gradient
steps over its training rows from shared weights, and the weights are averaged by how often each row of them was used. Counts cover all training rows:
only the HEAD most frequent words (bounded in number and length) go to all workers, the counts of the rest meet their texts in a join.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common
from scriptorium.llm.common import TOKEN_ROWS, batch, bound_batches, held_remainder, materialize, texts_of, tidy

HEAD = 100_000
HEAD_BYTES = 64
#: Documents fall into groups by the signs of so many random projections.
SIGNS = 3
GROUPS = 1 << SIGNS
CLUSTERS, BANDS = 6, 3
N_CLASSES = CLUSTERS * BANDS + 2
RARE, END = N_CLASSES - 2, N_CLASSES - 1
#: Rows of weights for the word before, the second and the third before it, and the pair before: for ROW_TOKENS training tokens or
#: fewer; each doubling of the tokens doubles them, up to MOST_ROWS times as many (26 MB of weights).
ROWS = (8192, 8192, 8192, 16384)
ROW_TOKENS, MOST_ROWS = 1 << 26, 8
#: Children of a node in a class's tree of words, at most, and rows of weights of all nodes (a quarter for each kind of feature; they double as ROWS do).
FAN, FAN_ROWS = 16, 1 << 16
RARE_CODES = 4096
STEP_TOKENS = 32_768
#: Training tokens of one task, about: each task sends its weights once, so that what they shuffle follows the tokens, not the number of files' parts.
TASK_TOKENS = 1 << 24
RATE = 0.15
#: Rows of weights that are worked on together, so that what is computed of them stays in a core's cache.
NEAR_ROWS = 4096
BLOCK = 256
#: Bytes of text that a worker looks at together; a longer text is alone.
SLAB_BYTES = 2 << 20


_BLANKS = b"\t\n\v\f\r "
_LOWER = bytes(range(256)).lower()


def words_column(texts: list[bytes], known: pa.Array | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of texts, one text after the other, each distinct word once in the dictionary; the number of words of each text.

    known: distinct words with which the dictionary begins, so that they needn't be looked up.
    """
    joined = b" ".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    blank = np.flatnonzero((raw == 32) | (raw - np.uint8(9) < 5))
    first = np.flatnonzero(np.diff(blank, prepend=-1) > 1)  # the first blank after a word ends it; other blanks go
    ends = blank[first]
    places = np.append(0, ends - first).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(joined.translate(_LOWER, _BLANKS))])
    words = words.dictionary_encode() if known is None else pa.concat_arrays([known, words]).dictionary_encode().slice(len(known))
    text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return words, np.diff(np.searchsorted(ends, text_ends), prepend=0)


def listed(words: pa.DictionaryArray) -> list[bytes]:
    """The dictionary's words; by numpy, as to_pylist() makes a scalar of each first."""
    return words.dictionary.to_numpy(zero_copy_only=False).tolist()


def _training(docs: DataFrame) -> DataFrame:
    return texts_of(docs).filter(held_remainder("doc_id", 7) != 2)


def slabs(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have SLAB_BYTES together, so that a worker's memory doesn't follow the batch."""
    return common.slabs(b, column, SLAB_BYTES)


# --- counts ---

_GROUPS = [f"n{k}" for k in range(GROUPS)]
_COUNTS = pa.schema([("word", pa.binary()), *((n, pa.int64()) for n in _GROUPS)])


class _Sums:
    """Rows of counts by word, added up."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.sums = np.zeros((1024, GROUPS), np.int64)

    def add(self, words: list[bytes], counts: np.ndarray) -> None:
        at = self.at
        rows = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
        if len(at) > len(self.sums):
            self.sums = np.concatenate((self.sums, np.zeros((len(at) + len(at) // 2 - len(self.sums), GROUPS), np.int64)))
        self.sums[rows] += counts

    def rows(self) -> Iterator[pa.RecordBatch]:
        words, sums = list(self.at), self.sums
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield batch(_COUNTS, [part, *sums[k : k + len(part)].T])
        self.__init__()


def count_words(docs: DataFrame, most: int = 150_000) -> DataFrame:
    """word, c, and n0, n1, ...: counts of all training tokens, and those by group of document; the end is the empty word.

    Workers add up before the shuffle, at most about ``most`` words at a time.
    """

    def partial(batches):
        held, crc = _Sums(), zlib.crc32
        for whole in batches:
            for b in slabs(whole, 0):
                words, sizes = words_column(b.column(0).to_pylist())
                known, own = listed(words), words.indices.to_numpy().astype(np.int64)
                hashes = np.fromiter(map(crc, known), np.int64, len(known))
                text = np.repeat(np.arange(len(sizes)), sizes)
                group = np.zeros(len(sizes), np.int64)
                for k in range(SIGNS):
                    group += (np.bincount(text, (hashes >> k & 1)[own] * 2 - 1, len(sizes)) > 0).astype(np.int64) << k
                held.add(known, np.bincount(own * GROUPS + group[text], minlength=len(known) * GROUPS).reshape(-1, GROUPS))
                held.add([b""], np.bincount(group, minlength=GROUPS)[None, :])
                if len(held.at) >= most:
                    yield from held.rows()
        if held.at:
            yield from held.rows()

    ddl = ", ".join(["word binary", *(f"{n} long" for n in _GROUPS)])
    found = _training(docs).select(F.col("text").cast("binary")).mapInArrow(tidy(partial), ddl).groupBy("word").agg(*(F.sum(n).alias(n) for n in _GROUPS))
    return found.select("word", sum((F.col(n) for n in _GROUPS), F.lit(0)).alias("c"), *_GROUPS)


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words of counts, at most ``most``: all whose count reaches a bound that a histogram of the counts gives.

    Only the histogram comes to the driver: 64 bars for each doubling, so that counts up to 64 have bars of their own.
    """
    bar = F.floor(F.log2("c") * 64)
    fits, total = None, 0
    for r in sorted(counts.groupBy(bar.alias("bar")).count().collect(), key=lambda r: -r.bar):
        total += r["count"]
        if total > most:
            break
        fits = r.bar
    return counts.filter(bar >= fits) if fits is not None else counts.limit(0)


# --- the model ---


@dataclass
class Model:
    """ids of head words; log10 of base probability and of the probability within its class of each id; classes of ids; weights.

    Id 0 is the end. n, v: tokens and types of training; rare_n, rare_v: those of words outside the head.
    With a tree (see with_words): nodes on the way to each id (-1: none), their number, and the child taken at each; logarithms of the children's shares
    of each node's counts; weights of nodes. Without one, words have their shares of the class.
    """

    ids: dict[bytes, int]
    base: np.ndarray
    within: np.ndarray
    classes: np.ndarray
    n: int
    v: int
    rare_n: int
    rare_v: int
    bias: np.ndarray
    weights: np.ndarray
    nodes: np.ndarray | None = None
    lengths: np.ndarray | None = None
    turns: np.ndarray | None = None
    shares: np.ndarray | None = None
    fan_weights: np.ndarray | None = None

    @cached_property
    def head(self) -> pa.Array:
        """Head words in the order of their ids, from 1."""
        return pa.array(list(self.ids), pa.binary())

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Codes of all texts' tokens, each text followed by its end; where texts end; the words (no ends) as a dictionary array.

        Words outside the head get a hash's code.
        """
        words, counts = words_column(texts, self.head)
        rare = words.dictionary.slice(len(self.head)).to_numpy(zero_copy_only=False).tolist()
        own = np.arange(1, len(words.dictionary) + 1)
        own[len(self.head) :] = [len(self.base) + zlib.crc32(w) % RARE_CODES for w in rare]
        ends = np.cumsum(counts + 1)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = own[words.indices.to_numpy()]
        return out, ends, words

    def hashes(self, codes: np.ndarray, place: np.ndarray, at: int, to: int) -> list[np.ndarray]:
        """A hash of 24 bits of each feature of the tokens from at to to; place: each token's number in its text."""
        before = []
        for k in (1, 2, 3):
            shifted = np.zeros(to - at, np.int64)
            low = max(at, k)
            shifted[low - at :] = codes[low - k : to - k] + 1
            shifted[place[at:to] < k] = 0
            before.append(shifted.astype(np.uint64))
        return [_mixed(h, k) for k, h in enumerate(before)] + [_mixed(before[0] * np.uint64(1 << 20) + before[1], 3)]

    def rows(self, codes: np.ndarray, place: np.ndarray, at: int = 0, to: int | None = None) -> np.ndarray:
        """Rows of weights that hold at the tokens from at to to; place: each token's number in its text."""
        return self.class_rows(self.hashes(codes, place, at, len(codes) if to is None else to))

    def class_sizes(self) -> list[int]:
        """Rows of weights of each feature of classes."""
        return [n * (len(self.weights) // sum(ROWS)) for n in ROWS]

    def node_sizes(self) -> list[int]:
        return [len(self.fan_weights) // len(ROWS)] * len(ROWS)

    def class_rows(self, hashed: list[np.ndarray]) -> np.ndarray:
        sizes = self.class_sizes()
        first = np.cumsum((0, *sizes[:-1]))
        return np.stack([(h & np.uint64(n - 1)).astype(np.int64) + a for h, n, a in zip(hashed, sizes, first, strict=True)]).T  # sizes are powers of two

    def targets(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < len(self.classes), self.classes[np.minimum(codes, len(self.classes) - 1)], RARE)

    def class_logs(self, rows: np.ndarray) -> np.ndarray:
        """Natural logarithms of class probabilities (float32)."""
        return _softmax_logs(self.weights, rows, self.bias)

    def ways(self, codes: np.ndarray, hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The choices within classes that lead to codes: token, node, child taken and rows of the nodes' weights of each."""
        n, depth = self.nodes.shape
        length = np.where(codes < n, np.take(self.lengths, codes, mode="clip"), 0)
        token, ends = np.repeat(np.arange(len(codes)), length), np.cumsum(length)
        cell = np.arange(len(token)) + np.take(codes * depth - ends + length, token)  # a word's choices come first in its row
        node, turn = np.take(self.nodes, cell, mode="clip"), np.take(self.turns, cell, mode="clip")
        each = len(self.fan_weights) // len(hashed)  # a power of two
        own, rows = node.astype(np.uint64) * _MIX, np.empty((len(hashed), len(token)), np.uint64)
        for k, h in enumerate(hashed):  # _mixed((h << 20) + node, k) of each choice, with the product of h taken once for each token
            np.take((h << np.uint64(20)) * _MIX + np.uint64(k), token, out=rows[k], mode="clip")
            rows[k] += own
            rows[k] *= _MIXED
            rows[k] >>= np.uint64(40)
            rows[k] &= np.uint64(each - 1)
            rows[k] += np.uint64(k * each)
        return token, node, turn, rows.view(np.int64).T

    def node_logs(self, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of each node's children (float32)."""
        return _softmax_logs(self.fan_weights, rows, np.take(self.shares, node, axis=0))

    def within_logs(self, codes: np.ndarray, hashed: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of head words' probabilities within their classes, after the words before them; 0 for other words."""
        if self.nodes is None:
            return np.where(codes < len(self.within), self.within[np.minimum(codes, len(self.within) - 1)], 0) * np.log(10)
        token, node, turn, rows = self.ways(codes, hashed)
        return np.bincount(token, _taken_logs(self.fan_weights, rows, self.shares, turn, node), len(codes))


_MIX, _MIXED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    return (h * _MIX + np.uint64(salt)) * _MIXED >> np.uint64(40)


def _softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponents, their exponentials and each row's sum of those; rows of exponents are shifted only where a sum could leave float32.

    of: which row of bias is added to each; without it, bias itself is.
    """
    z = np.take(weights, rows[:, 0], axis=0, mode="clip")  # rows are in range; to clip is the fastest mode
    z += bias if of is None else np.take(bias, of, axis=0, mode="clip")
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0, mode="clip")
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(z)
        sums = e @ ones
    if len(sums) and not (sums.min() > 1e-20 and sums.max() < 1e20):
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        sums = e @ ones
    return z, e, sums


def _softmax_logs(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z, _, sums = _softmax(weights, rows, bias)
    z -= np.log(sums)[:, None]
    return z


def _near(rows: np.ndarray, bias: np.ndarray, of: np.ndarray | None) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray | None]]:
    """rows, and what of bias and of goes with them, NEAR_ROWS at a time."""
    for a in range(0, len(rows), NEAR_ROWS):
        own = slice(a, a + NEAR_ROWS)
        yield own, rows[own], bias[own] if of is None and bias.ndim > 1 else bias, None if of is None else of[own]


def _taken_logs(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, taken: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The logarithm of one probability of each row."""
    logs = np.empty(len(rows), np.float32)
    for own, *part in _near(rows, bias, of):
        z, _, sums = _softmax(weights, *part)
        np.subtract(z.reshape(-1)[np.arange(len(z)) * z.shape[1] + taken[own]], np.log(sums), out=logs[own])
    return logs


def _slopes(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, taken: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """By how much the logarithm of the probability of what was taken grows with each exponent."""
    slopes = np.empty((len(rows), weights.shape[1]), np.float32)
    for own, *part in _near(rows, bias, of):
        _, e, sums = _softmax(weights, *part)
        np.divide(e, -sums[:, None], out=slopes[own])
    slopes.reshape(-1)[np.arange(len(taken)) * slopes.shape[1] + taken] += 1
    return slopes


def n_rows(tokens: int) -> int:
    """Rows of weights for so many training tokens."""
    scale = 1
    while scale < MOST_ROWS and tokens > scale * ROW_TOKENS:
        scale *= 2
    return scale * sum(ROWS)


def places(ends: np.ndarray) -> np.ndarray:
    """Each token's number in its text, from 0."""
    sizes = np.diff(ends, prepend=0)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def clusters_of(by_group: np.ndarray) -> np.ndarray:
    """The cluster of each word (rows of counts by group, the most frequent first): spherical k-means from far-apart frequent words."""
    if not len(by_group):
        return np.zeros(0, np.int64)
    c = by_group.sum(axis=1, keepdims=True)
    X = np.sqrt(by_group + by_group.sum(axis=0) / c.sum())
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    weight = np.sqrt(c)
    centres, near = X[:1], X[:500] @ X[0]
    for _ in range(1, CLUSTERS):
        centres = np.vstack((centres, X[int(near.argmin())]))
        near = np.maximum(near, X[:500] @ centres[-1])
    for _ in range(20):
        own = (X @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(own, (X[:, d : d + 1] * weight)[:, 0], CLUSTERS) for d in range(X.shape[1])], axis=1)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-9), centres)
    return (X @ centres.T).argmax(axis=1)


def build_model(counts: DataFrame, head: int = HEAD) -> Model:
    """The model before training, from all counts; of them the head comes to the driver."""
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    short = counts.filter((F.length("word") > 0) & (F.length("word") <= HEAD_BYTES))
    top = head_of(short, head).toArrow()
    words, number = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-number[k], words[k]))
    ids = {words[k]: at for at, k in enumerate(order, 1)}
    c = np.concatenate(([ends], number[order])).astype(np.float64)
    cluster = clusters_of(np.stack([top.column(x).to_numpy()[order] for x in _GROUPS], axis=1).astype(np.float64))
    band = np.minimum(BANDS * np.cumsum(c[1:]) / max(1.0, c[1:].sum()) - 1e-9, BANDS - 1).astype(np.int64)
    classes = np.concatenate(([END], cluster * BANDS + band)).astype(np.int64)
    rare_n, rare_v = int(n - c.sum()), int(v - len(words) - (1 if ends else 0))
    mass = np.bincount(classes, c, N_CLASSES)
    mass[RARE] = rare_n
    within = np.log10(np.maximum(c, 1) / np.maximum(mass[classes], 1))
    return Model(ids, np.log10((c + 1) / (n + v + 1)), within, classes, int(n), int(v), rare_n, rare_v, np.log((mass + 1) / (n + N_CLASSES)).astype(np.float32), np.zeros((n_rows(n), N_CLASSES), np.float32))


def _merged(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents and turns of a tree over words of so much mass: the least ones meet in a node of up to FAN children until one is left (Huffman).

    Words come first, nodes after them; the last node is the root, without a parent (-1).
    """
    heap = [(m, k) for k, m in enumerate(mass.tolist())]
    heapq.heapify(heap)
    above, turn, take = [-1] * len(heap), [0] * len(heap), (len(heap) - 2) % (FAN - 1) + 2  # only the first node may have fewer than FAN
    while len(heap) > 1:
        least = [heapq.heappop(heap) for _ in range(take)]
        for t, (_, k) in enumerate(least):
            above[k], turn[k] = len(above), t
        heapq.heappush(heap, (sum(m for m, _ in least), len(above)))
        above.append(-1)
        turn.append(0)
        take = FAN
    return np.array(above, np.int64), np.array(turn, np.int64)


def with_words(model: Model) -> Model:
    """model with a tree for each class, in which frequent words have few nodes on their way, and weights 0: words have their shares of the class until it is trained."""
    share, ways = 10.0**model.within, []
    tables, n = [np.ones((0, FAN))], 0
    for k in np.unique(model.classes).tolist():
        word = np.flatnonzero(model.classes == k)
        above, turn = _merged(share[word])
        mass = np.append(share[word], np.zeros(len(above) - len(word)))
        table = np.zeros((len(above) - len(word), FAN))
        for child in range(len(above) - 1):  # children come before their nodes
            mass[above[child]] += mass[child]
            table[above[child] - len(word), turn[child]] = mass[child]
        at, level, shift = np.arange(len(word)), 0, n - len(word)
        while len(word := word[inner := above[at] >= 0]):
            at = at[inner]
            ways.append((level, word, above[at] + shift, turn[at]))
            at, level = above[at], level + 1
        tables.append(table)
        n += len(table)
    depth = 1 + max((level for level, *_ in ways), default=0)
    nodes, turns = np.full((len(model.classes), depth), -1, np.int64), np.zeros((len(model.classes), depth), np.int64)
    for level, word, node, taken in ways:
        nodes[word, level], turns[word, level] = node, taken
    mass = np.concatenate(tables)
    with np.errstate(divide="ignore"):
        shares = np.maximum(np.log(mass) - np.log(mass.sum(axis=1, keepdims=True)), -1e4).astype(np.float32)  # -1e4: no such child
    return replace(model, nodes=nodes, lengths=(nodes >= 0).sum(axis=1), turns=turns, shares=shares, fan_weights=np.zeros((FAN_ROWS * (len(model.weights) // sum(ROWS)), FAN), np.float32))


def sums_by_row(column: np.ndarray, slope: np.ndarray, short: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows named in column, how often each is, and the sum of its slopes; rows that are named more than once come first.

    Most rows are named a few times only: the first slopes of all rows are added up together, then the second ones, and so on up to
    ``short``; what is left of the others is added row by row.
    """
    both = np.sort(column << 20 | np.arange(len(column)))  # numbers that hold row and place sort faster than places by row
    row, order = both >> 20, both & ((1 << 20) - 1)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(order)))
    bar = np.maximum(short + 1 - n, 0).astype(np.uint8)
    falling = np.argsort(bar, kind="stable")
    first, n = first[falling], n[falling]
    longer = np.cumsum(np.bincount(bar, minlength=short + 1))[::-1]  # of each number of slopes, from 0: how many rows have more
    sums = np.take(slope, order[first], axis=0, mode="clip")
    for k in range(1, short):
        if not (m := longer[k]):
            break
        sums[:m] += np.take(slope, order[first[:m] + k], axis=0, mode="clip")
    if m := longer[short]:
        left = n[:m] - short
        start = np.cumsum(left) - left
        at = np.repeat(first[:m] + short - start, left) + np.arange(left.sum())
        sums[:m] += np.add.reduceat(np.take(slope, order[at], axis=0, mode="clip"), start, axis=0)
    return row[first], n, sums


def put_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row copied as one value."""
    whole = np.dtype((np.void, table.itemsize * table.shape[1]))
    np.put(table.reshape(-1).view(whole), at, np.ascontiguousarray(rows).reshape(-1).view(whole), mode="clip")


def aligned(table: np.ndarray) -> np.ndarray:
    """A copy of table that begins at a cache line."""
    room = np.empty(table.nbytes + 64, np.uint8)
    a = -room.ctypes.data % 64
    out = room[a : a + table.nbytes].view(table.dtype).reshape(table.shape)
    out[:] = table
    return out


class _Steps:
    """Weights that change by adaptive gradient steps, and how often each row of them was used; sizes: rows of each feature."""

    def __init__(self, weights: np.ndarray, sizes: list[int]):
        self.weights, self.squares, self.used, self.sizes = aligned(weights), aligned(np.zeros_like(weights)), np.zeros(len(weights), np.int64), sizes
        self.sums = aligned(np.zeros_like(weights[: max(sizes)]))

    def add(self, rows: np.ndarray, slope: np.ndarray) -> None:
        """One step from the slopes of softmaxes whose weights are in rows, a feature a column."""
        first = 0
        for column, size in zip(rows.T, self.sizes, strict=True) if len(rows) else ():
            touched, n, g = sums_by_row(column, slope)
            self.used[touched] += n
            more = int((n > 1).sum())  # they come first
            g[:more] /= np.sqrt(n[:more], dtype=np.float32)[:, None]
            if 3 * len(touched) > size:  # all rows of the feature in turn take less time than those; the others' slopes are 0
                put_rows(self.sums, touched - first, g)
                for k in range(first, first + size, NEAR_ROWS):
                    to = min(k + NEAR_ROWS, first + size)
                    g, squares = self.sums[k - first : to - first], self.squares[k:to]
                    squares += g * g
                    self.weights[k:to] += _step(g, squares)
                    g[:] = 0
            else:
                for k in range(0, len(touched), NEAR_ROWS):
                    at, part = touched[k : k + NEAR_ROWS], g[k : k + NEAR_ROWS]
                    squares = np.take(self.squares, at, axis=0, mode="clip")
                    squares += part * part
                    put_rows(self.squares, at, squares)
                    put_rows(self.weights, at, np.take(self.weights, at, axis=0, mode="clip") + _step(part, squares))
            first += size


def _step(g: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """By how much weights change; g is used up."""
    g *= np.float32(RATE)
    root = squares + np.float32(1)
    g /= np.sqrt(root, out=root)
    return g


def gradient_steps(model: Model, outer: _Steps, inner: _Steps | None, codes: np.ndarray, ends: np.ndarray) -> None:
    """Adaptive gradient steps over the tokens, STEP_TOKENS at a time: of the class softmax (outer) and of the nodes' (inner)."""
    place, own = places(ends), replace(model, weights=outer.weights, fan_weights=inner and inner.weights)
    for k in range(0, len(codes), STEP_TOKENS):
        part = codes[k : k + STEP_TOKENS]
        t, hashed = model.targets(part), model.hashes(codes, place, k, k + len(part))
        r = model.class_rows(hashed)
        outer.add(r, _slopes(own.weights, r, own.bias, t))
        if inner:
            _, node, turn, r = own.ways(part, hashed)
            inner.add(r, _slopes(own.fan_weights, r, own.shares, turn, node))


_SHARE = pa.schema([("block", pa.int32()), ("used", pa.binary()), ("sums", pa.binary())])


def training_tasks(rows: DataFrame, tokens: int) -> DataFrame:
    """rows in as few partitions as give each about TASK_TOKENS, and every core equally many of them; never more than they have."""
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.coalesce(cores * max(1, -(-tokens // (TASK_TOKENS * cores))))


def train(docs: DataFrame, model: Model, epochs: int = 1) -> Model:
    """model with trained weights: in each epoch every task steps through its rows, then weights are averaged by use."""
    spark = docs.sparkSession
    rows = training_tasks(_training(docs).select(F.col("text").cast("binary")), model.n)
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(model)

        def steps(batches, shared=shared):
            model = shared.value
            outer, inner = _Steps(model.weights, model.class_sizes()), None if model.nodes is None else _Steps(model.fan_weights, model.node_sizes())
            for b in batches:
                for slab in slabs(b, 0):
                    gradient_steps(model, outer, inner, *model.codes(slab.column(0).to_pylist())[:2])
            before = 0
            for own in (outer, inner):
                for a in range(0, len(own.used) if own else 0, BLOCK):
                    if (used := own.used[a : a + BLOCK]).any():
                        yield batch(_SHARE, [[before + a // BLOCK], [used.tobytes()], [(own.weights[a : a + BLOCK] * used[:, None]).astype(np.float32).tobytes()]])
                before += -(-len(own.used) // BLOCK) if own else 0

        def added(batches):
            """Running sums by block: as much memory as the weights of these blocks, however many partitions there are."""
            uses, sums = defaultdict(lambda: np.zeros(BLOCK, np.int64)), {}
            for b in batches:
                for k, u, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    uses[k] += np.frombuffer(u, np.int64)
                    s = np.frombuffer(s, np.float32)
                    sums[k] = sums[k] + s if k in sums else s.astype(np.float64)
            if uses:
                yield batch(_SHARE, [list(uses), [uses[k].tobytes() for k in uses], [sums[k].astype(np.float32).tobytes() for k in uses]])

        ddl = "block int, used binary, sums binary"
        found = rows.mapInArrow(tidy(steps), ddl).repartition("block").mapInArrow(tidy(added), ddl).collect()  # the rows of weights, once
        weights, fan = np.zeros_like(model.weights), None if model.nodes is None else np.zeros_like(model.fan_weights)
        first = len(weights) // BLOCK
        for r in found:
            of, block = (weights, r.block) if r.block < first else (fan, r.block - first)
            used = np.frombuffer(r.used, np.int64)
            of[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(r.sums, np.float32).reshape(BLOCK, -1) / np.maximum(used, 1)[:, None]
        model = replace(model, weights=weights, fan_weights=fan)
    return model


_SCORES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("whole", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text; null text: empty): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Without training rows every probability of the base is 1. A null id counts as the empty string in held_out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def parts(batches):
        """One row a text with what the head gives, and one for each rarer word of it, whose count is not here."""
        model = shared.value
        end_known = int(model.n > 0)
        for b in (slab for whole in batches for slab in slabs(whole, 2)):
            names, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            codes, ends, words = model.codes(b.column(2).to_pylist())
            place, logs = places(ends), np.empty(len(codes))
            for k in range(0, len(codes), STEP_TOKENS):
                part = codes[k : k + STEP_TOKENS]
                target, hashed = model.targets(part), model.hashes(codes, place, k, k + len(part))
                logs[k : k + len(part)] = _taken_logs(model.weights, model.class_rows(hashed), model.bias, target) + model.within_logs(part, hashed)
            head = codes < len(model.base)
            at = np.minimum(codes, len(model.base) - 1)
            total = np.add.reduceat(np.stack((np.where(head, model.base[at], 0), logs / np.log(10), head), axis=1), np.concatenate(([0], ends[:-1])), axis=0)
            sizes = np.diff(ends, prepend=0)
            whole = [names, own, [b" %d" % r for r in own], np.zeros(len(own), np.int64), np.ones(len(own), np.int64), sizes, total[:, 2].astype(np.int64) - 1 + end_known, total[:, 0], total[:, 1]]
            yield batch(_SCORES, whole)
            rare = np.flatnonzero(~head)
            if len(rare):
                text = np.searchsorted(ends, rare, side="right")
                n_words = len(words.dictionary)
                pair, times = np.unique(text * n_words + words.indices.to_numpy()[rare - text].astype(np.int64), return_counts=True)
                text, word = pair // n_words, pair % n_words
                none = np.zeros(len(pair), np.int64)
                yield batch(_SCORES, [b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), words.dictionary.take(pa.array(word)), times, none, none, none, none.astype(float), none.astype(float)])

    ddl = "doc_id long, row long, word binary, times long, whole long, tokens long, known long, base double, score double"
    found = texts_of(docs).select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary")).mapInArrow(tidy(parts), ddl)
    # A row for a whole text has a key with a blank, which no word has: it meets no count and spreads evenly.
    met = found.join(counts.select("word", "c"), "word", "left")
    c, all_n, rare_all = F.coalesce("c", F.lit(0)), model.n + model.v + 1, model.rare_n + model.rare_v + 1
    times = F.col("times")
    sums = met.groupBy("doc_id", "row").agg(
        F.sum("whole").alias("copies"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when(c > 0, times).otherwise(0)).alias("known"),
        F.sum(F.col("base") + times * F.log10((c + 1) / F.lit(float(all_n)))).alias("base"),
        F.sum(F.col("score") + times * F.log10((c + 1) / F.lit(float(rare_all)))).alias("score"),
    )
    each = lambda name: (F.col(name) / F.col("copies")).alias(name)
    rows = sums.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), *map(each, ("tokens", "known", "base", "score")))
    held = (held_remainder("doc_id", 7) == 2).alias("held_out")
    return rows.select("doc_id", held, F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def score_corpus(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Learn from the training rows of docs and score all of them: see score()."""
    bound_batches(docs.sparkSession, TOKEN_ROWS)
    counts = materialize(count_words(docs), "counts")
    return score(docs, counts, train(docs, with_words(build_model(counts, head))))
