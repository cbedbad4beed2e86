"""SimHash near-duplicates: vantage-point trees over fingerprints, links within a Hamming radius, connected components.

A fingerprint has 64 bits for each of ``lanes`` hash seeds and is cut into ``blocks`` equal blocks. Two fingerprints link if they
differ in at most ``radius`` bits and in at most ``block_radius`` bits of some block; if block_radius is radius // blocks, the
second follows from the first and every link within radius is found. For each block a vantage-point tree, built on a bounded
sample, deals the distinct fingerprints over shards by the Hamming distance of that block: a fingerprint lives in one shard
(home) and also asks in each shard whose ball or shell its own ball overlaps by the triangle inequality. Within a shard a
second tree finds the candidates, whose whole distance is then taken. The sample decides only how evenly shards fill, never
which links are found. A shard that holds more than SHARD_ROWS is dealt by hash into a grid of cells, each of which compares
a share of the askers with a share of those at home.

``one_of_each`` needs links at a similarity that distances of fingerprints don't tell sharply. Its candidates come from the same search
over fingerprints of LANES lanes in many short blocks, then the exact similarity of the shingle sets decides among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import batch, bound_batches, materialize, release, tidy

SHINGLE = 3
RADIUS = 3
BLOCKS = 2
SEED = 42
#: Near copies: sets of five-word shingles whose Jaccard similarity is at least share, as a fraction.
NEAR_COPIES = {"words": 5, "share": (4, 5)}
#: Sets become candidates if their wide fingerprints differ in WIDE_RADIUS bits at most in one of WIDE_BLOCKS blocks (21 or 22 bits each), and in
#: NEAR_CHECK at most of the 128 bits of the next two lanes: at 0.8, where 15 of 100 bits differ, no block is that near 8 times in 100,000.
LANES, WIDE_BLOCKS, WIDE_RADIUS, NEAR_CHECK = 20, 60, 1, 40
#: Fingerprints that a shard of a wide block is meant to hold, and rows of one from which it becomes a grid of cells.
WIDE_SHARD, WIDE_ROWS = 1 << 18, 1 << 20
#: Least size of the trees' sample, and its size for each shard.
SAMPLE, SAMPLE_EACH = 20_000, 8
SHARD_ROWS = 8_192
#: Distinct fingerprints that a shard of the tree is meant to hold.
SHARD_AIM = 2_048
MAX_SHARDS = 1 << 16
#: Shingles that a share of a group of candidates is meant to hold; a cell compares two shares.
SHARE_SHINGLES = 500_000
#: After a cell of more than so many bytes a worker gives free memory back.
RELEASE_BYTES = 1 << 20
#: Below so many fingerprints a shard's own tree compares all.
LEAF = 192
FAN = 8
#: Links that one task thins at a time, on average.
THIN_LINKS = 50_000


def simhash(text: bytes, words: int = SHINGLE, lanes: int = 1) -> bytes:
    """The fingerprint of a text as UTF-8, eight big-endian bytes a lane: A-Z lower-cased, shingles of words between blanks, a bit where over half the hashes have it."""
    found = text.lower().split()
    if not found:
        return bytes(8 * lanes)
    line, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    starts, ends = ((end - size)[: len(found) - words + 1].tolist(), end[words - 1 :].tolist()) if len(found) >= words else ([0], [len(line)])
    hash_of, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros((lanes, 64), np.int64)
    for k in range(0, n, 65_536):
        h = np.array([hash_of(line[a:b], SEED) for a, b in zip(starts[k : k + 65_536], ends[k : k + 65_536], strict=True)], np.uint64)
        for lane in range(lanes):
            ones[lane] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            h = h * np.uint64(0x9E3779B97F4A7C15) ^ h >> np.uint64(29)  # the next lane's hashes follow from this one's
            h = h * np.uint64(0xD6E8FEB86659FD93) ^ h >> np.uint64(32)
    return np.packbits(ones * 2 > n, axis=1).tobytes()


def fingerprints(docs: DataFrame, words: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """doc_id, row (a hash of the text) and fp of each row of docs; a null text counts as empty."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.binary())])

    def hashed(batches):
        for b in batches:
            yield batch(schema, [b.column(0), b.column(1), [simhash(x, words, lanes) for x in b.column(2).to_pylist()]])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row"), text.cast("binary")).mapInArrow(tidy(hashed), "doc_id long, row long, fp binary")


def unpacked(fps: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of uint64."""
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1) if fps else np.zeros((0, 1), np.uint64)


def block_bits(values: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """The bits of a block of fingerprints; blocks must be a multiple of their lanes."""
    each = blocks // values.shape[1]
    low, high = 64 * (block % each) // each, 64 * (block % each + 1) // each
    return (values[:, block // each] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


class ShardTree:
    """A vantage-point tree over values of some bits; its leaves are numbered shards.

    Inner nodes hold a vantage point and a distance mu: nearer or equal lies inside, the rest outside.
    """

    def __init__(self, sample: np.ndarray, shards: int, rng: np.random.Generator):
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, mu, inside, outside; a child below 0 is shard -1 - child
        self.shards = 0
        self.root = self._build(sample, shards, rng)

    def _leaf(self) -> int:
        self.shards += 1
        return -self.shards

    def _build(self, sample: np.ndarray, shards: int, rng) -> int:
        if shards <= 1 or len(sample) < 2:
            return self._leaf()
        best = None
        for v in rng.choice(sample, min(6, len(sample)), replace=False):
            d = np.bitwise_count(sample ^ v)
            mu = int(np.sort(d)[(len(d) - 1) // 2])
            if mu >= int(d.max()):
                mu = int(d.max()) - 1
            edge = np.count_nonzero((d == mu) | (d == mu + 1)) + abs(2 * np.count_nonzero(d <= mu) - len(d))
            if mu >= 0 and (best is None or edge < best[0]):
                best = (edge, int(v), mu, d <= mu)
        if best is None:  # all are equal
            return self._leaf()
        _, v, mu, inside = best
        at = len(self.nodes)
        self.nodes.append((v, mu, 0, 0))
        share = max(1, min(shards - 1, round(shards * np.count_nonzero(inside) / len(inside))))
        a = self._build(sample[inside], share, rng)
        b = self._build(sample[~inside], shards - share, rng)
        self.nodes[at] = (v, mu, a, b)
        return at

    def reach(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, shard) of all shards that may hold a value within radius of each."""
        at, shard, todo = [], [], [(self.root, np.arange(len(values)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                at.append(own)
                shard.append(np.full(len(own), -1 - node))
            elif len(own):
                v, mu, a, b = self.nodes[node]
                d = np.bitwise_count(values[own] ^ np.uint64(v)).astype(np.int64)
                todo += [(a, own[d - radius <= mu]), (b, own[d + radius > mu])]
        return np.concatenate(at), np.concatenate(shard)


def near_pairs(home: np.ndarray, asking: np.ndarray, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (asking, home) of values within radius, from a vantage-point tree that is split for all askers at once."""
    todo = [(np.arange(len(home)), np.arange(len(asking)))]
    while todo:
        h, a = todo.pop()
        if not len(h) or not len(a):
            continue
        if len(h) > LEAF:
            v = home[h[rng.integers(len(h))]]
            d = np.bitwise_count(home[h] ^ v).astype(np.int64)
            mu = int(np.sort(d)[(len(d) - 1) // 2])
            if mu >= d.max():
                mu = int(d.max()) - 1
            if mu >= 0:
                e = np.bitwise_count(asking[a] ^ v).astype(np.int64)
                todo += [(h[d <= mu], a[e - radius <= mu]), (h[d > mu], a[e + radius > mu])]
                continue
        step = max(1, (1 << 20) // len(h))
        for k in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(asking[a[k : k + step]][:, None] ^ home[h][None, :]) <= radius)
            yield a[k + x], h[y]


def roots_within(values: np.ndarray, radius: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each one's component, of those pairs whose values differ in at most radius bits."""
    parent = np.arange(len(values))
    for a, b in pairs:
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        near = np.bitwise_count(values[a] ^ values[b]).sum(axis=1) <= radius
        a, b = a[near], b[near]
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (above := parent[parent]).tobytes() != parent.tobytes():
                parent = above
    return parent


def _tree(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) of a tree over each component, in which none has more than FAN + 1 links; root: components by number."""
    order = np.lexsort((np.arange(len(root)), root))  # members of a component together
    start = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1]))) if len(root) else order
    first = np.repeat(start, np.diff(np.append(start, len(order))))
    rank = np.arange(len(order)) - first
    child = rank > 0
    return order[child], order[first[child] + (rank[child] - 1) // FAN]


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer links (a, b) that join the same fingerprints: each of the parts that links are dealt into by hash keeps a forest.

    Different blocks link the members of a large group each in their own way; a forest has less than one link a member.
    """
    parts = -(-edges.count() // THIN_LINKS)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def forest(batches):
        table = pa.Table.from_batches([*batches], schema)
        ends = pa.concat_arrays([c for name in "ab" for c in table.column(name).chunks] or [pa.array([], pa.binary())]).dictionary_encode()
        at = ends.indices.to_numpy()
        n = len(at) // 2
        root = roots_within(np.zeros((len(ends.dictionary), 1), np.uint64), 0, iter([(at[:n], at[n:])]))
        child, up = _tree(root)
        yield pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(child)), ends.dictionary.take(pa.array(up))], schema=schema)

    if parts == 0:
        return edges
    return edges.repartition(parts).mapInArrow(tidy(forest), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cells(placed: DataFrame, most: int) -> DataFrame:
    """Rows (block, shard, fp, home, ...) with way, side and asks instead of home: every asker meets every one at home in one cell.

    Every shard is a grid of cells: ways askers by sides at home, one by one unless it holds more than most.
    """
    sizes = placed.groupBy("block", "shard").agg(F.count("*").alias("n"), F.count_if("home").alias("m"))
    big = sizes.filter((F.col("n") > most) | (F.col("m") > most)).select("block", "shard", F.ceil(F.col("n") / most).cast("int").alias("ways"), F.ceil(F.col("m") / most).cast("int").alias("sides"))
    grid = placed.join(F.broadcast(big), ["block", "shard"], "left")  # at most blocks * MAX_SHARDS rows
    one = lambda c: F.coalesce(c, F.lit(1))
    ways, sides = one(F.col("ways")), F.greatest(F.lit(1), one(F.col("sides")))
    way, side = F.pmod(F.xxhash64("fp"), ways).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), sides).cast("int")
    to = lambda n, at, asks: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(k)[0].alias("way"), at(k)[1].alias("side"), F.lit(asks).alias("asks")))
    asks = to(sides, lambda k: (way, k), True)
    lives = to(ways, lambda k: (k, side), False)
    kept = [c for c in placed.columns if c != "home"]
    return grid.select(*kept, F.explode(F.concat(asks, F.when(F.col("home"), lives).otherwise(F.array().cast("array<struct<way:int,side:int,asks:boolean>>")))).alias("c")).select(*kept, "c.*")


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, block_radius: int | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints of distinct (fp) that join all that link, directly or through others.

    A cell sends a tree of few links for each component it finds rather than all pairs.
    """
    reach = radius // blocks if block_radius is None else block_radius
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, n // SHARD_AIM))
    part = min(1.0, max(SAMPLE, SAMPLE_EACH * shards) / max(n, 1))
    drawn = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(part * (1 << 30)))  # of all rows, by hash: about as many as wanted
    sample = unpacked(sorted(bytes(r.fp) for r in drawn.collect()))
    rng = np.random.default_rng(SEED)
    trees = [ShardTree(np.sort(block_bits(sample, k, blocks)), shards, rng) if len(sample) else ShardTree(np.zeros(0, np.uint64), 1, rng) for k in range(blocks)]
    asked = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("fp", pa.binary()), ("home", pa.bool_())])

    def ask(batches):
        for b in batches:
            values = unpacked(b.column(0).to_pylist())
            for k, tree in enumerate(trees if len(values) else []):
                own = block_bits(values, k, blocks)
                at, shard = tree.reach(own, reach)
                home = np.zeros(len(values), np.int64)
                here, lives = tree.reach(own, 0)
                home[here] = lives
                yield batch(asked, [np.full(len(at), k, np.int32), shard.astype(np.int32), b.column(0).take(pa.array(at)), home[at] == shard])

    placed = materialize(distinct.mapInArrow(tidy(ask), "block int, shard int, fp binary, home boolean"), "asked")
    cells = _cells(placed, SHARD_ROWS)

    def in_cell(pdf):
        import pandas as pd

        block, values = int(pdf["block"].iat[0]), unpacked(pdf["fp"].tolist())
        known, at = np.unique(values, axis=0, return_inverse=True)
        asks = pdf["asks"].to_numpy()
        home, asking = np.unique(at[~asks]), np.unique(at[asks])
        bits = block_bits(known, block, blocks)
        pairs = ((asking[x], home[y]) for x, y in near_pairs(bits[home], bits[asking], reach, np.random.default_rng(SEED)))
        root = roots_within(known, radius, pairs)
        child, up = _tree(root)
        packed = known.astype(">u8")
        return pd.DataFrame({"a": [x.tobytes() for x in packed[child]], "b": [x.tobytes() for x in packed[up]]})

    found = cells.groupBy("block", "shard", "way", "side").applyInPandas(in_cell, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp and label (the least fp of its component) of every end of edges (a, b).

    In each round every end takes its least neighbour, then that one's, and links move to what their ends have taken: those that
    come to equal ends go, equal ones become one. What ends have taken is linked as they were, so the labels of the links that are left
    are theirs too. A link meets labels once rather than in every round; rounds go through tables in the shared folder.
    """
    spark = edges.sparkSession
    left, taken = materialize(edges.select("a", "b"), "edges"), []
    while not taken or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("low")), "least")
        jump = least.select(F.col("fp").alias("low"), F.col("low").alias("label"))
        labels = materialize(least.join(jump, "low").select("fp", "label"), "labels")
        taken.append(labels)
        end = lambda c, to, labels=labels: labels.select(F.col("fp").alias(c), F.col("label").alias(to))
        moved = left.join(end("a", "x"), "a").join(end("b", "y"), "b").filter("x != y")
        left = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    found = taken.pop()
    while taken:
        found = taken.pop().join(found.select(F.col("fp").alias("label"), F.col("label").alias("last")), "label", "left").select("fp", F.coalesce("last", "label").alias("label"))
    return materialize(found, "labels")


def groups(docs: DataFrame, words: int = SHINGLE, lanes: int = 1, radius: int = RADIUS, blocks: int = BLOCKS, block_radius: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, row, fp, and least (doc_id, row) of its component: the least doc_id there is, nulls last.

    Texts of equal fingerprint are one node, however many.
    """
    hashed = materialize(fingerprints(docs, words, lanes), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = materialize(hashed.groupBy("fp").agg(F.min(first).alias("least")), "nodes")
    labels = components(thinned(materialize(links(nodes.select("fp"), radius, blocks, block_radius), "links")))
    tagged = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = tagged.groupBy("label").agg(F.min("least").alias("of"))
    known = materialize(tagged.join(named, "label").select("fp", F.col("of.doc_id").alias("least_id"), F.col("of.row").alias("least_row")), "components")
    return hashed.join(known, "fp")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (hexadecimal), component_id (the least doc_id that links reach).

    A null text is empty (fingerprint zero, linked like any other); a row without an id gets its component's least id, null
    if no member has one. Repeated rows stay.
    """
    return groups(docs, **how).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("least_id").alias("component_id"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a text with fewer words is one shingle, one without words has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    starts, ends = ((end - size)[: len(found) - words + 1].tolist(), end[words - 1 :].tolist()) if len(found) >= words else ([0], [len(line)])
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_simhash(shingles: np.ndarray) -> bytes:
    """The fingerprint of LANES lanes of a set of hashes: a bit where over half the hashes have it in that lane."""
    ones = np.zeros(LANES * 64, np.int64)
    for k in range(0, len(shingles), 255):  # so many ones fit a byte
        h = shingles[k : k + 255, None] * _ODD
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(shingles)).tobytes()


def wide_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the first eight bytes of fp of nodes (fp, sim), which join all whose wide fingerprints sim are candidates.

    As links, but a row carries its block, a check of two lanes and eight bytes of its name rather than the whole fingerprint.
    """
    n = nodes.count()
    shards = min(MAX_SHARDS, max(1, n // WIDE_SHARD))
    part = 0 if shards == 1 else min(1.0, 256 * shards / n)
    drawn = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(part * (1 << 30))).select("sim") if part else None  # one shard needs no tree
    sample = unpacked(sorted(bytes(r.sim) for r in drawn.collect())) if part else np.zeros((0, LANES), np.uint64)
    rng = np.random.default_rng(SEED)
    trees = [ShardTree(np.sort(block_bits(sample, k, WIDE_BLOCKS)), shards, rng) for k in range(WIDE_BLOCKS)]
    asked = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("fp", pa.int64()), ("bits", pa.int64()), ("check0", pa.int64()), ("check1", pa.int64()), ("home", pa.bool_())])

    def ask(batches):
        for b in batches:
            values = unpacked(b.column(1).to_pylist())
            name = np.array([int.from_bytes(x[:8], "big", signed=True) for x in b.column(0).to_pylist()], np.int64)
            for k, tree in enumerate(trees if len(name) else []):
                own, lane = block_bits(values, k, WIDE_BLOCKS), k * LANES // WIDE_BLOCKS
                at, shard = tree.reach(own, WIDE_RADIUS)
                home = np.zeros(len(values), np.int64)
                here, lives = tree.reach(own, 0)
                home[here] = lives
                checks = [values[at, (lane + x) % LANES].view(np.int64) for x in (1, 2)]
                yield batch(asked, [np.full(len(at), k, np.int32), shard.astype(np.int32), name[at], own[at].astype(np.int64), *checks, home[at] == shard])

    ddl = "block int, shard int, fp long, bits long, check0 long, check1 long, home boolean"
    cells = _cells(nodes.select("fp", "sim").mapInArrow(tidy(ask), ddl), WIDE_ROWS)

    def in_cell(part: pa.Table) -> pa.Table:
        name, bits, *checks = (part.column(c).to_numpy() for c in ("fp", "bits", "check0", "check1"))
        asks = part.column("asks").to_numpy()
        bits, check = bits.astype(np.uint64), np.stack(checks, axis=1).view(np.uint64)
        home, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        known, first, at = np.unique(name, return_index=True, return_inverse=True)
        pairs = ((at[asking[x]], at[home[y]]) for x, y in near_pairs(bits[home], bits[asking], WIDE_RADIUS, np.random.default_rng(SEED)))
        child, up = _tree(roots_within(check[first], NEAR_CHECK, pairs))
        made = pa.table({c: pa.array([x.to_bytes(8, "big", signed=True) for x in known[at].tolist()], pa.binary()) for c, at in (("a", child), ("b", up))})
        if part.nbytes > RELEASE_BYTES:
            release()
        return made

    found = cells.groupBy("block", "shard", "way", "side").applyInArrow(in_cell, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_roots(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """A member of each set's component, where sets (distinct values) of Jaccard similarity share or more are linked. Exact.

    From each set the search goes to all of those not reached yet that are similar. A similar set must have one of the set's
    rarest shingles, as many as it may lack and one; only if some set has is the whole overlap counted.
    """
    up, down = share
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    root, open_ = np.arange(n), np.ones(n, bool)
    known, term = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, np.int64))
    own = np.split(term, np.cumsum(size)[:-1]) if n else []
    order = np.argsort(term, kind="stable")
    term, owner = term[order], np.repeat(np.arange(n), size)[order]

    def index():
        """Postings of the sets not reached yet: places of each shingle, their sets by place among members, and members."""
        members = np.flatnonzero(open_)
        local = np.cumsum(open_) - 1
        return np.searchsorted(term, np.arange(len(known) + 1)), local[owner], members

    def holders(shingles):
        low, count = place[shingles], place[shingles + 1] - place[shingles]
        return at[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]

    (place, at, members), left = index(), n
    for first in range(n):
        if not open_[first]:
            continue
        open_[first], left, todo = False, left - 1, [first]
        while todo and left:
            x = todo.pop()
            if left * 2 < len(members):
                stay = open_[owner]
                term, owner = term[stay], owner[stay]
                place, at, members = index()
            may_lack = size[x] - -(-up * size[x] // down)
            rarest = own[x][np.argsort(place[own[x] + 1] - place[own[x]], kind="stable")[: may_lack + 1]]
            if not open_[members[holders(rarest)]].any():
                continue
            common = np.bincount(holders(own[x]), minlength=len(members))
            near = members[(common > 0) & (down * common >= up * (size[x] + size[members] - common))]
            near = near[open_[near]]
            open_[near], root[near] = False, first
            left -= len(near)
            todo += near.tolist()
    return root


def similar_groups(docs: DataFrame, words: int, share: tuple[int, int], share_shingles: int = SHARE_SHINGLES) -> DataFrame:
    """As groups, but rows are linked where the Jaccard similarity of their shingle sets is at least share.

    Rows of equal sets are one node. Candidates are nodes that wide fingerprints join (see wide_links), directly or through others. A group of them is dealt by
    hash into shares of about ``share_shingles`` shingles; each cell compares two shares (one, where there is no other), so that
    every two candidates meet, and sends a tree of links for each component it finds.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.binary()), ("size", pa.int64()), ("sim", pa.binary())])

    def hashed_rows(batches):
        for b in batches:
            sets = [shingle_set(x, words) for x in b.column(2).to_pylist()]
            yield batch(schema, [b.column(0), b.column(1), [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [*map(len, sets)], [wide_simhash(x) for x in sets]])

    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.xxhash64(text).alias("row"), text.cast("binary").alias("bytes"))
    hashed = materialize(named.mapInArrow(tidy(hashed_rows), "doc_id long, row long, fp binary, size long, sim binary"), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = materialize(hashed.groupBy("fp").agg(F.min(first).alias("least"), F.min("size").alias("size"), F.min("sim").alias("sim")), "nodes")
    joined = components(thinned(materialize(wide_links(nodes), "links"))).withColumnRenamed("fp", "name")
    candidates = materialize(nodes.drop("sim").withColumn("name", F.substring("fp", 1, 8)).join(joined, "name").drop("name"), "candidates")
    large = candidates.groupBy("label").agg(F.ceil(F.sum("size") / share_shingles).cast("int").alias("shares")).filter("shares > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")
    pair = lambda k: F.struct(F.least(own, k).alias("way"), F.greatest(own, k).alias("side"))
    others = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), pair)
    cells = F.when(F.col("shares") > 1, F.filter(others, lambda c: c["way"] != c["side"])).otherwise(F.transform(F.array(F.lit(0)), pair))
    wanted = candidates.join(large, "label", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    wanted = wanted.select("fp", "label", cells.alias("cells"), F.coalesce("least.doc_id", F.lit(-(2**63))).alias("id"), F.col("least.row").alias("row"))
    met_texts = named.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), "row", "bytes").join(wanted, ["id", "row"])
    placed = met_texts.select("label", F.explode("cells").alias("c"), "fp", "bytes").select("label", "c.way", "c.side", "fp", "bytes")

    def exact(part: pa.Table) -> pa.Table:
        fps = part.column("fp").to_pylist()
        once = list({fp: k for k, fp in enumerate(fps)}.values())  # rows may be repeated
        fps, column = [fps[k] for k in once], part.column("bytes")
        child, up = _tree(similar_roots([shingle_set(column[k].as_py(), words) for k in once], share))
        made = pa.table({"a": pa.array([fps[k] for k in up], pa.binary()), "b": pa.array([fps[k] for k in child], pa.binary())})
        if part.nbytes > RELEASE_BYTES:
            release()
        return made

    similar = placed.groupBy("label", "way", "side").applyInArrow(exact, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = components(thinned(materialize(similar, "similar")))
    tagged = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of = tagged.groupBy("label").agg(F.min("least").alias("of"))
    known = materialize(tagged.join(of, "label").select("fp", F.col("of.doc_id").alias("least_id"), F.col("of.row").alias("least_row")), "components")
    return hashed.drop("sim", "size").join(known, "fp")


def one_of_each(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """docs without near copies (see similar_groups): of each group the row of least doc_id stays, of repeated rows one.

    All columns stay as they are, whatever their names; a null text counts as empty. An empty table gives no rows.
    """
    found = similar_groups(docs, words, share)
    same = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("row") == F.col("least_row"))
    keepers = found.filter(same).select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), "row").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    turn = F.row_number().over(Window.partitionBy("id", "row").orderBy(F.lit(0)))
    return keyed.join(keepers, ["id", "row"]).withColumn("turn", turn).filter("turn = 1").select("whole.*")
