"""Toxic spans by a linear-chain conditional random field of two states, and document scores from its marginals.

Labels mark whole documents, so token labels come first: in a bounded sample of labelled training rows, the words and word
beginnings that stand significantly more often in toxic documents than in clean ones are tagged in the toxic documents. The field
learns hashed word, beginning and neighbour features and transitions from those tokens; forward-backward gives each token its
marginal probability, and a logistic curve over their sum of squares and its density gives the document's score.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BLANKS, batch, bound_batches, held_remainder, materialize, texts_of, tidy

#: Bounds of the training sample: labelled rows of either class, and the code points of all their texts together.
#: Texts of any length are taken, and taken whole.
SAMPLE_ROWS = 800
SAMPLE_CHARS = 3_000_000
#: Tokens that training runs through as one chain; features and scores look beyond its ends.
CHAIN = 256
WEIGHTS = 1 << 18
STEPS = 40
PURITY = 25
#: Added to the sum of squared marginals before its logarithm.
FLOOR = 0.05
#: A token is offending where its marginal is at least this.
OFFENDING = 0.5

_PUNCTUATION = string.punctuation.encode()
_MASK = np.uint64(WEIGHTS - 1)
#: Bytes of the beginnings of a word that are features.
BEGINNINGS = (4, 6, 7, 8)
N_UNITS = 1 + len(BEGINNINGS)
#: Odd multipliers that mix 64 bits.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def token_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each token, with its punctuation."""
    return [m.span() for m in re.finditer(f"[^{BLANKS}]+", text) if m[0].strip(string.punctuation)]


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens are words between blanks, A-Z lower-cased, without ASCII punctuation; words of nothing else are left out.

    Returns a row of 64-bit hashes a token, of the word and of its beginnings, and each text's number of tokens.
    """
    parts = [t.encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).lower() for t in texts]
    raw = np.frombuffer(b" ".join(parts) + bytes(32), np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    word[-32:] = False
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_end = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    counts = np.diff(np.searchsorted(start, text_end), prepend=0)
    size = end - start

    def eight(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place, as a number."""
        got = raw[at[:, None] + np.arange(8)].view("<u8")[:, 0]
        n = np.clip(n, 0, 8).astype(np.uint64)
        return np.where(n > 7, got, got & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1)))

    first = eight(start, size)
    second = np.zeros_like(first)
    more = np.flatnonzero(size > 8)
    second[more] = eight(start[more] + 8, size[more] - 8) * _MIX[1] ^ eight(end[more] - 8, size[more]) * _MIX[2]
    columns = [_mixed(first ^ second ^ size.astype(np.uint64) * _MIX[3], 0)]
    columns += [_mixed(first & np.uint64((1 << 8 * k) - 1), k) for k in BEGINNINGS]
    return np.stack(columns, axis=1), counts


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * int(_MIX[0]) % (1 << 64))) * _MIX[4]
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    return h ^ (h >> np.uint64(29))


def feature_columns(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weight indexes, one row a token: its units, the word before and the word after; texts end at ends."""
    word = hashes[:, 0]
    before, after = np.roll(word, 1), np.roll(word, -1)
    if len(word):
        ends = ends[ends > 0]
        after[ends - 1] = 1
        before[np.concatenate(([0], ends[:-1])) % len(word)] = 1
    around = np.stack((before * _MIX[1], after * _MIX[2]), axis=1) >> np.uint64(20)
    return (np.concatenate((hashes, around), axis=1) & _MASK).astype(np.int32)


@dataclass
class Field:
    """weights of toxic over clean by feature; bias; log transition weights from clean to toxic, toxic to clean, toxic to toxic; curve of the score."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    curve: np.ndarray | None
    prior: float

    def emissions(self, columns: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[columns].sum(axis=1, dtype=np.float64) + self.bias, -30, 30))

    def marginals(self, emission: list[float]) -> np.ndarray:
        """Of one document: each token's probability of being toxic, by forward-backward on odds."""
        t01, t10, t11 = np.exp(self.moves).tolist()
        forward, back, r, s = [], [], 0.0, 1.0
        for e in emission:
            r = e * (t01 + r * t11) / (1.0 + r * t10)
            forward.append(r)
        for e in reversed(emission):
            back.append(s)
            x = e * s
            s = (t10 + t11 * x) / (1.0 + t01 * x)
        odds = np.array(forward) * np.array(back[::-1])
        return odds / (1.0 + odds)

    def score(self, marginals: np.ndarray) -> float:
        z = float(evidence([np.square(marginals).sum()], [len(marginals)])[0] @ self.curve)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def evidence(strength: list[float], n: list[int]) -> np.ndarray:
    """Rows of the score's logistic curve: one, the logarithms of the sum of squared marginals, and of that sum for each token."""
    found = np.asarray(strength, float) + FLOOR
    return np.stack((np.ones_like(found), np.log(found), np.log(found / (np.asarray(n) + 50.0))), axis=1)


def significant(hashes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Units in more toxic texts than chance allows: a log-likelihood ratio beyond that of the most extreme of as many units.

    Of those, only units at least PURITY times as common in toxic texts as in clean ones.
    """
    owner = np.repeat(np.repeat(np.arange(len(counts)), counts), hashes.shape[1])
    seen = _distinct_pairs(hashes.reshape(-1), owner)
    unit, at = np.unique(seen[:, 0], return_inverse=True)
    label = toxic[seen[:, 1].astype(np.int64)]
    a, b = np.bincount(at, label, len(unit)), np.bincount(at, 1 - label, len(unit))
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    if not n1 or not n0:
        return unit[:0]
    n, rate = a + b, n1 / (n1 + n0)
    ratio = 2 * (a * np.log(np.maximum(a, 1) / (n * rate)) + b * np.log(np.maximum(b, 1) / (n * (1 - rate))))
    return unit[(a / n > rate) & (ratio > 2 * math.log(len(unit) + 2)) & (a / n1 > PURITY * (b + 0.5) / n0)]


def _distinct_pairs(unit: np.ndarray, owner: np.ndarray) -> np.ndarray:
    if not len(unit):
        return np.zeros((0, 2), np.uint64)
    order = np.lexsort((owner, unit))
    unit, owner = unit[order], owner[order]
    new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])))
    return np.stack((unit[new], owner[new].astype(np.uint64)), axis=1)


def _padded(flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.zeros((max(sizes, default=0), len(sizes)))
    at = 0
    for k, n in enumerate(sizes):
        out[:n, k] = flat[at : at + n]
        at += n
    return out


def fit_field(texts: list[str], toxic: list[int], share: float) -> Field:
    """Train on sampled texts; share is the part of toxic rows among all labelled ones."""
    hashes, counts = units(texts)
    label = np.array(toxic, np.int64)
    found = significant(hashes, counts, label)
    keep = np.flatnonzero(counts)
    field = Field(np.zeros(WEIGHTS, np.float32), -4.0, np.array([-2.0, 0.0, -1.0]), None, share)
    if not len(keep) or not len(found):
        return field
    ends = np.cumsum(counts[keep])
    whole = feature_columns(hashes, ends)
    y = (np.isin(hashes, found).any(axis=1) & (np.repeat(label, counts) == 1)).astype(np.float64)
    chains = [(at, min(at + CHAIN, end)) for end, n in zip(ends.tolist(), counts[keep].tolist(), strict=True) for at in range(end - n, end, CHAIN)]
    chains.sort(key=lambda c: c[0] - c[1])  # long first: a step takes a prefix of chains
    sizes = [b - a for a, b in chains]
    pick = np.concatenate([np.arange(a, b) for a, b in chains])
    columns, y = whole[pick], y[pick]
    shown, Y = _padded(np.ones(len(y)), sizes) > 0, _padded(y, sizes)
    live = shown.sum(axis=1)
    field.bias = math.log(max(y.mean(), 1e-6)) - 3  # not learned: a token of unknown features is clean
    theta = np.concatenate((np.zeros(WEIGHTS), [field.bias], field.moves))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat_at = np.concatenate([np.arange(n) * len(sizes) + k for k, n in enumerate(sizes)])
    T = len(live)
    for step in range(1, STEPS + 1):
        w, t01, t10, t11 = theta[:WEIGHTS], *np.exp(theta[WEIGHTS + 1 :])
        e = np.exp(np.clip(_padded(w[columns].sum(axis=1) + theta[WEIGHTS], sizes), -30, 30))
        r, s = np.zeros_like(e), np.ones_like(e)
        for t in range(T):
            n = live[t]
            last = r[t - 1, :n] if t else np.zeros(n)
            r[t, :n] = e[t, :n] * (t01 + last * t11) / (1 + last * t10)
        for t in range(T - 2, -1, -1):
            n = live[t + 1]
            x = e[t + 1, :n] * s[t + 1, :n]
            s[t, :n] = (t10 + t11 * x) / (1 + t01 * x)
        odds = r * s
        p = odds / (1 + odds)
        slope = (Y - p).reshape(-1)[flat_at]
        both = shown[1:]
        x = e[1:] * s[1:]
        pairs = np.stack([np.where(both, k, 0.0) for k in (np.ones_like(x), t01 * x, r[:-1] * t10, r[:-1] * t11 * x)])
        pairs /= np.maximum(pairs.sum(axis=0), 1e-300)
        u, v = Y[:-1], Y[1:]
        gain = [((1 - u) * v * both).sum() - pairs[1].sum(), (u * (1 - v) * both).sum() - pairs[2].sum(), (u * v * both).sum() - pairs[3].sum()]
        gradient = np.concatenate((sum(np.bincount(columns[:, k], slope, WEIGHTS) for k in range(columns.shape[1])), [0.0], gain))
        gradient -= 0.05 * theta
        gradient[WEIGHTS] = 0.0
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta += 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    field.weights, field.bias, field.moves = theta[:WEIGHTS].astype(np.float32), float(theta[WEIGHTS]), theta[WEIGHTS + 1 :]
    emission = np.split(field.emissions(whole), ends[:-1])
    strength = np.zeros(len(texts))
    for k, x in zip(keep, emission, strict=True):
        strength[k] = np.square(field.marginals(x.tolist())).sum()
    field.curve = _logistic(evidence(strength, counts), label.astype(float), share)
    return field


def _logistic(X: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Coefficients by Newton's method with halved steps, slightly ridged; classes weigh as they do among all labelled rows."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(X.shape[1])

    def loss(beta: np.ndarray) -> float:
        z = X @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * beta @ beta)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        H = X.T @ (X * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(H, X.T @ (weight * (y - p)) - 0.1 * beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-6:
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def taken(sizes: list[tuple[int, int]], rows: int, chars: int) -> list[int]:
    """Of (id, size) in order: the first ``rows`` ids of which none makes the sizes' sum exceed ``chars``."""
    out, total = [], 0
    for name, size in sizes:
        if total + size <= chars and len(out) < rows:
            out.append(name)
            total += size
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Field:
    """Fit on at most ``rows`` labelled rows of either class, in the order of their ids' hash, whose whole texts have ``chars`` code points together at most.

    A row whose text doesn't fit any more is passed over; a class none of whose rows fits is an error. Only labels of ids whose crc32 modulo 5
    isn't 0 are read. An id with several labels is toxic if one says so, an id with several texts has the least of them. Without labels
    of both classes every text gets the share of toxic labels as its score, 0 if there are none.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(held_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n1 = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    lengths = texts_of(docs).select("doc_id", F.length("text").alias("size"))  # no text goes into the join
    longest = lengths.join(known, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("size").alias("size"))
    sizes = materialize(longest.select("doc_id", "toxic", "size", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("turn")), "label_sizes")
    picked = []
    for label, many in sorted((r.toxic, r["count"]) for r in sizes.groupBy("toxic").count().collect()):
        part = sizes.filter((F.col("toxic") == label) & (F.col("turn") < int(min(1.0, 2 * rows / many) * (1 << 30))))  # about 2 * rows rows, or all
        ids = taken([(r.doc_id, r.size) for r in sorted(part.collect(), key=lambda r: (r.turn, r.doc_id))], rows, chars)
        if not ids:
            raise ValueError(f"no labelled text with toxic = {label} has at most {chars} code points; raise chars")
        picked += [(i, label) for i in ids]
    if not picked:
        return fit_field([], [], 0.0)
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    found = texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = found.collect()  # at most 2 * rows texts of 2 * chars code points together
    sample.sort(key=lambda r: r.doc_id)
    return fit_field([r.text for r in sample], [int(r.toxic) for r in sample], n1 / n if n else 0.0)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.string())])


def score_texts(field: Field, texts: list[str]) -> tuple[list[float], list[str]]:
    """Document scores, and offending spans as start:end in code points, joined by commas."""
    hashes, counts = units(texts)
    ends = np.cumsum(counts)
    emission = field.emissions(feature_columns(hashes, ends)).tolist()
    scores, spans = [], []
    trained = field.curve is not None
    for text, n, end in zip(texts, counts.tolist(), ends.tolist(), strict=True):
        p = field.marginals(emission[end - n : end]) if n and trained else np.zeros(0)
        scores.append(field.score(p) if trained else field.prior)
        bad = np.flatnonzero(p >= OFFENDING).tolist()
        where = token_spans(text) if bad else []
        spans.append(",".join(f"{where[k][0]}:{where[k][1]}" for k in bad))
    return scores, spans


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of docs (doc_id, text; null text: empty): doc_id, held_out, score, predicted, spans. A null id counts as the empty string in held_out."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(field)  # WEIGHTS numbers

    def scored(batches):
        for b in batches:
            scores, spans = score_texts(model.value, b.column(1).to_pylist())
            yield batch(_OUT, [b.column(0), scores, spans])

    out = texts_of(docs).mapInArrow(tidy(scored), "doc_id long, score double, spans string")
    return out.select("doc_id", (held_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, field: Field) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; all columns stay as they are, whatever their names."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(field)

    at = docs.columns.index("text")

    def mild(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([x < 0.5 for x in score_texts(model.value, texts)[0]], pa.bool_()))

    return docs.mapInArrow(tidy(mild), docs.schema)
