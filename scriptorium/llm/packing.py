"""Best-fit packing into sequences of fixed capacity, improved by swap-based local search.

Documents become pieces of at most the capacity; only the lengths are packed. Pieces are dealt by hash into blocks of
bounded size, which tasks pack alone; what lies in sequences that a block leaves underfull is dealt again, with such
pieces of other blocks, so that the last round leaves at most one part-filled sequence for each of its few blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import TOKEN_ROWS, batch, bound_batches, materialize, slabs, texts_of, tidy

BLOCK_PIECES = 16_384
#: A sequence at least so full is final in the rounds before the last.
SEALED = 0.998
ROUNDS = 3
#: Bytes of text that are encoded together: the pieces of new units take many times as much memory.
SLAB_BYTES = 2 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of indexes into lengths) by best fit, longest first; ties by index."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # sorted, those with bins
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[b].append(i)
        if room - n:
            if not by_room[room - n]:
                insort(rooms, room - n)
            by_room[room - n].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move a document, or exchange one for one or two for one, from emptier bins into fuller ones while squared fill grows.

    Each accepted step takes tokens from the emptier bin of two to the fuller one, so the sum of squared fills grows and the
    search ends; a bin that becomes empty goes. Only bins with room take part, and no step is tried once their number is
    the least that their tokens need. Rounds go over all bins, the emptiest first, until in a whole round none has a step.
    """
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    loose = [list(b) for b in bins if sum(lengths[i] for i in b) < capacity]
    changed = True
    while changed and (search := _Search(loose, lengths, capacity)).can_shrink():
        changed = search.round()
        full += [b for b, f in zip(search.bins, search.fill.tolist(), strict=True) if f == capacity]
        loose = [b for b, f in zip(search.bins, search.fill.tolist(), strict=True) if 0 < f < capacity]
    return full + loose


class _Search:
    """A round of local_search. What targets may give back is kept in arrays: nothing or a document (``back``), or two."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.left = len(bins)
        self.least = -(-int(self.fill.sum()) // capacity)
        items = [i for b in bins for i in b]
        self.item = np.array([-1] * len(bins) + items, np.int64)
        self.back = np.array([0] * len(bins) + [lengths[i] for i in items], np.int64)
        self.where = np.array([*range(len(bins)), *(k for k, b in enumerate(bins) for _ in b)], np.int64)
        self.place = {i: len(bins) + k for k, i in enumerate(items)}
        self.fresh = np.ones(len(bins), bool)  # bins that no step of this round has changed
        pairs = [self._pairs(b) for b in bins]
        self.pair_where = np.repeat(np.arange(len(bins)), [len(x) for x in pairs])
        self.pair = np.array([y for x in pairs for y in x], np.int64).reshape(-1, 2)
        self.pair_back = np.array(lengths, np.int64)[self.pair].sum(axis=1)

    def _pairs(self, items: list[int]) -> list[tuple[int, int]]:
        """Two documents for each two lengths that a bin holds; documents of equal length stand for each other.

        A bin has fewer than sqrt(2 * capacity) different lengths, so there are fewer pairs than tokens, however many documents it holds.
        """
        of: dict[int, list[int]] = {}
        for i in items:
            of.setdefault(self.lengths[i], []).append(i)
        firsts = [same[0] for same in of.values()]
        return [(i, j) for k, i in enumerate(firsts) for j in firsts[k + 1 :]] + [(same[0], same[1]) for same in of.values() if len(same) > 1]

    def can_shrink(self) -> bool:
        return self.left > self.least

    def round(self) -> bool:
        changed = False
        for v in np.argsort(self.fill, kind="stable").tolist():
            while self.bins[v] and self.can_shrink():
                t, given, taken = self._step(v)
                if not given:
                    break
                changed = True
                self._carry(given, v, t)
                self._carry(taken, t, v)
                self.fresh[[v, t]] = False
                self.left -= not self.bins[v]
            if not self.can_shrink():
                break
        return changed

    def _carry(self, what: list[int], a: int, b: int) -> None:
        for i in what:
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.where[self.place[i]] = b
            self.fill[a] -= self.lengths[i]
            self.fill[b] += self.lengths[i]

    def _step(self, v: int) -> tuple[int, list[int], list[int]]:
        """The step from v to a bin at least as full that gives most tokens: (bin, given, taken); given is empty if there is none."""
        own = self.bins[v]
        gifts = sorted((n, [i]) for n, i in {self.lengths[i]: i for i in own}.items())
        more = sorted(gifts + [(self.lengths[i] + self.lengths[j], [i, j]) for i, j in self._pairs(own)])
        room = self.capacity - self.fill
        room[(self.fill < self.fill[v]) | (self.fill == 0)] = 0
        room[v] = 0
        best, found = 0, (v, [], [])
        for offers, back, where, backs in ((more, self.back, self.where, self.item), (gifts, self.pair_back, self.pair_where, self.pair)):
            if not len(back):
                continue
            sizes = np.array([n for n, _ in offers], np.int64)
            space = room[where] if backs.ndim == 1 else np.where(self.fresh[where], room[where], 0)
            k = np.searchsorted(sizes, back + space, side="right") - 1
            gain = np.where((k >= 0) & (space > 0), sizes[k] - back, 0)
            e = int(gain.argmax())
            if gain[e] > best:
                best, taken = gain[e], [i for i in np.atleast_1d(backs[e]).tolist() if i >= 0]
                found = (int(where[e]), offers[k[e]][1], taken)
        return found


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pieces_of(docs: DataFrame, encoder: Callable[[], Callable], end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Per piece of each text (null: empty), with end_id after its ids: doc_id, piece, start, length, ids_crc32, row (a hash of id and text)."""
    bound_batches(docs.sparkSession, TOKEN_ROWS)

    def pieces(batches):
        encode = encoder()
        for b in (slab for whole in batches for slab in slabs(whole, 1, SLAB_BYTES)):
            rows = []
            for name, row, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), encode(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((name, k, start, len(part), zlib.crc32(part.tobytes()), row))
            if rows:
                yield batch(_PIECES, [*zip(*rows, strict=True)])

    return texts_of(docs).withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(pieces: DataFrame, capacity: int = 4096, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: every piece once, gapless, at most capacity tokens in a sequence."""
    left, done = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "row"), []
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, sealed boolean"

    def packer(turn: int, last: bool) -> Callable[[pa.Table], pa.Table]:
        def pack_block(part: pa.Table) -> pa.Table:
            number = part.column("block")[0].as_py()
            part = part.drop_columns("block")
            length, row, piece = (part.column(c).to_numpy() for c in ("length", "row", "piece"))
            part = part.take(pa.array(np.lexsort((piece, row, -length))))
            lengths = part.column("length").to_pylist()
            sequence, offset, sealed = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), bool)
            for k, b in enumerate(pack_lengths(lengths, capacity)):
                at = 0
                for i in b:
                    sequence[i], offset[i] = (turn << 60) + (number << 24) + k, at
                    at += lengths[i]
                sealed[b] = last or at >= SEALED * capacity
            for name, values in (("sequence_id", sequence), ("offset", offset), ("sealed", sealed)):
                part = part.append_column(name, pa.array(values))
            return part

        return pack_block

    for turn in range(ROUNDS):
        n = left.count()
        blocks, last = -(-n // block_pieces), turn == ROUNDS - 1 or n <= block_pieces
        if not n:
            break
        dealt = left.withColumn("block", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(blocks)))
        packed = materialize(dealt.groupBy("block").applyInArrow(packer(turn, last), schema), f"packed{turn}")
        done.append(packed.filter("sealed"))
        if last:
            break
        left = packed.filter("not sealed").select(*left.columns)
    if not done:
        return left.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).drop("row")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("row", "sealed")


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable], end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack all docs (doc_id, text; other columns are ignored). Texts are read and encoded once.

    An empty or null text is a piece of one token. Rows of equal doc_id are packed each for itself. An empty table gives no rows.
    """
    return pack(materialize(pieces_of(docs, encoder, end_id, capacity), "pieces"), capacity)
