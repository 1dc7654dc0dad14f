"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so tokens are labelled first: a token of a toxic document is toxic if its word, or one of
its affixes, stands far more often in toxic than in clean documents. A two-state field over sentences learns from
those tokens with word, affix and shape features; forward-backward marginals give offending offsets, and a calibrated
sum of them gives a document's score.

Defined results: null and empty texts get the score of a text without any sign of toxicity; with no usable labels
every score is 0; each row is scored by itself, so repeated rows score alike; rows of labels that repeat an id count once,
with their highest label; texts of any length are read whole; other columns pass through, whatever their names; an empty
table gives an empty table. The sample that reaches the driver is bounded in rows and bytes."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, discard, packed, sampled_rows, settle, to_driver, with_arrow
from .language_id import slices

#: Labelled rows of a class at most, hash slots of features, training passes, and how much commoner in toxic documents a word or affix must be.
PER_CLASS, SLOTS, PASSES, LIFT = 2500, 1 << 18, 4, 6.0
#: Tokens that are scored at a time; a longer text is scored alone.
SLICE = 500_000
_EDGES = ".,;:!?\"'()[]|#*$%&<>"
_TOKEN = re.compile(r"\S+")
N_FEATURES = 9


#: Sums of the texts that a feature's name begins with, and slots of a feature that a word is too short for.
_PREFIX = [(k, zlib.crc32(f"p{k}:".encode()), zlib.crc32(f"s{k}".encode()) % SLOTS) for k in (3, 4, 5, 6)]
_SUFFIX = [(k, zlib.crc32(f"e{k}:".encode()), zlib.crc32(f"t{k}".encode()) % SLOTS) for k in (2, 3, 4)]
_WHOLE, _SHAPES = zlib.crc32(b"w:"), {}


def features(word: str) -> list[int]:
    """Slots of a word's features: itself, its prefixes and suffixes, and its shape.

    A feature is a name and a text, its slot their checksum, which goes on from that of the name."""
    crc, w = zlib.crc32, word.strip(_EDGES).lower()
    n, b = len(w), w.encode()
    shape = (word.isupper(), min(n, 9), not w.isalpha() and any(map(str.isdigit, w)))
    if shape not in _SHAPES:
        _SHAPES[shape] = crc(("x:" + ("U" if shape[0] else "l") + str(shape[1]) + ("d" if shape[2] else "-")).encode()) % SLOTS
    if len(b) == n:
        out = [crc(b[:k], start) % SLOTS if n > k else short for k, start, short in _PREFIX]
        out += [crc(b[-k:], start) % SLOTS if n > k else short for k, start, short in _SUFFIX]
    else:
        out = [crc(w[:k].encode(), start) % SLOTS if n > k else short for k, start, short in _PREFIX]
        out += [crc(w[-k:].encode(), start) % SLOTS if n > k else short for k, start, short in _SUFFIX]
    return [crc(b, _WHOLE) % SLOTS, *out, _SHAPES[shape]]


def bounds(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the sentences of a token stream."""
    last = np.flatnonzero(ends)
    if len(ends) and (not len(last) or last[-1] != len(ends) - 1):
        last = np.append(last, len(ends) - 1)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    return start, last - start + 1


def marginals(e: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all sentences at once, those of like length together, on log odds.

    (P(state 1) of every token, expected transitions 2 x 2). trans[a, b]: weight of b after a."""
    out, pairs = np.empty(len(e)), np.zeros((2, 2))
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        most = max(8, int(length[order[at]] * 1.5))
        end = np.searchsorted(length[order], most, "right")
        group = order[at:end]
        at = end
        n, s = length[group], start[group]
        steps = int(n.max())
        r = np.empty((steps, len(group)))
        x = np.empty((steps, len(group)))
        for t in range(steps):
            x[t] = e[np.minimum(s + t, s + n - 1)]
            r[t] = x[t] if t == 0 else x[t] + np.logaddexp(trans[0, 1], r[t - 1] + trans[1, 1]) - np.logaddexp(trans[0, 0], r[t - 1] + trans[1, 0])
        b = np.zeros(len(group))
        for t in range(steps - 1, -1, -1):
            live = t < n
            inner = t + 1 < n
            if t + 1 < steps:
                f = x[t + 1] + b
                if inner.any():
                    w = np.stack([trans[0, 0] + 0 * f, trans[0, 1] + f, r[t] + trans[1, 0], r[t] + trans[1, 1] + f])[:, inner]
                    w = np.exp(w - w.max(0))
                    pairs += (w / w.sum(0)).sum(1).reshape(2, 2)
                b = np.where(inner, np.logaddexp(trans[1, 0], trans[1, 1] + f) - np.logaddexp(trans[0, 0], trans[0, 1] + f), 0.0)
            out[(s + t)[live]] = 1 / (1 + np.exp(-np.clip((r[t] + b)[live], -50, 50)))
    return out, pairs


def weak_labels(word_of: np.ndarray, feats: np.ndarray, toxic: np.ndarray, least: int = 8) -> np.ndarray:
    """Labels of tokens: in toxic documents, and with a feature whose rate there is at least ``LIFT`` times that in clean ones."""
    n = np.bincount(word_of[toxic], minlength=len(feats)), np.bincount(word_of[~toxic], minlength=len(feats))
    strong = np.zeros(len(feats), bool)
    totals = max(1, n[0].sum()), max(1, n[1].sum())
    for k in range(0, 5):  # the word and its prefixes
        a, b = (np.bincount(feats[:, k], c, SLOTS) for c in n)
        lift = ((a + 0.5) / totals[0]) / ((b + 0.5) / totals[1])
        strong |= ((lift >= LIFT) & (a >= least))[feats[:, k]]
    return toxic & strong[word_of]


class Tagger:
    """The field's weights, and the weights that turn a document's marginals into its score."""

    def __init__(self) -> None:
        self.weights, self.trans = np.zeros(SLOTS, np.float32), np.zeros((2, 2))
        self.scale = None

    def fit(self, rows: list[tuple[str, int]], rate: float | None = None, seed: int = 7) -> Tagger:
        """rows: (text, label); rate: the share of label 1 among all rows that the sample stands for."""
        y = np.array([v for _, v in rows])
        if not len(y) or y.min() == y.max():
            return self
        known: dict[str, int] = {}
        words = []  # a text's words are kept as numbers only
        for text, _ in rows:
            t = text.split()
            words.append(np.fromiter((known.setdefault(w, len(known)) for w in t), np.int32, len(t)))
        n = np.array([len(t) for t in words])
        word_of = np.concatenate(words)
        del words
        feats = np.array([features(w) for w in known], np.int32).reshape(-1, N_FEATURES)
        doc = np.repeat(np.arange(len(n)), n)
        labels = weak_labels(word_of, feats, y[doc] == 1).astype(np.float32)
        ends = np.array([w[-1] in ".!?" for w in known], bool)[word_of]
        del known
        ends[np.cumsum(n)[n > 0] - 1] = True
        start, length = bounds(ends)
        turn = np.arange(len(start))
        w, g2, t2 = np.zeros(SLOTS), np.full(SLOTS, 1e-6), np.full((2, 2), 1e-6)
        bias, b2 = -4.0, 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(PASSES):
            rng.shuffle(turn)
            for part in np.array_split(turn, max(1, len(turn) // 8192)):
                s, m = start[part], length[part]
                take = np.repeat(s - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                own, yy = feats[word_of[take]], labels[take]
                s = np.cumsum(m) - m
                p, pairs = marginals(w[own].sum(1) + bias, s, m, self.trans)
                lo, hi = np.delete(np.arange(len(yy)), s + m - 1), np.delete(np.arange(len(yy)), s)
                seen = np.bincount((2 * yy[lo] + yy[hi]).astype(int), minlength=4).reshape(2, 2)
                err = yy - p
                grad = np.bincount(own.ravel(), np.repeat(err, N_FEATURES), SLOTS) - 1e-2 * w
                g2 += grad * grad
                w += 0.3 * grad / np.sqrt(g2)
                b2 += err.sum() ** 2
                bias += 0.3 * err.sum() / np.sqrt(b2)
                grad = seen - pairs
                t2 += grad * grad
                self.trans = np.clip(self.trans + 0.1 * grad / np.sqrt(t2), -6, 6)
        self.weights, self.bias = w.astype(np.float32), float(bias)
        p, _ = marginals(w[feats].sum(1)[word_of] + bias, start, length, self.trans)
        self.calibrate(summary(p, np.cumsum(n) - n, n), y, float((y == 1).mean()) if rate is None else rate)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        """Logistic regression on the summaries by Newton steps; classes weigh as they do among all rows."""
        mean, sd = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
        c, beta = np.where(y == 1, rate / (y == 1).mean(), (1 - rate) / (y == 0).mean()), np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            h = (z * (c * p * (1 - p))[:, None]).T @ z + 1.0 * np.eye(len(beta))
            beta += np.clip(np.linalg.solve(h, z.T @ (c * (y - p)) - 1.0 * beta), -2, 2)
        self.scale = (mean, sd, beta)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.scale is None:
            return np.zeros(len(x))
        mean, sd, beta = self.scale
        return 1 / (1 + np.exp(-np.clip(beta[0] + ((x - mean) / sd) @ beta[1:], -30, 30)))


def summary(p: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each document: the sum, share, highest and noisy-or of its tokens' marginals, on stretched scales."""
    out = np.zeros((len(n), 4))
    some = np.flatnonzero(n)
    if len(some):
        total = np.add.reduceat(p, start[some])
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), start[some])
        out[some] = np.column_stack([np.log1p(total), np.sqrt(total / n[some]), np.maximum.reduceat(p, start[some]), 1 - np.exp(none)])
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Tagger:
    """docs: doc_id and text; labels: doc_id and toxic, only rows one may learn from. A bounded sample reaches the driver."""
    usable = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    rate = usable.agg(F.avg("__y")).head()[0]
    picked = settle(sampled_rows(docs, bounded_sample(usable, "__y", PER_CLASS), 2 * PER_CLASS))  # found once, read twice
    rows = to_driver(picked, "__y")
    discard(picked)
    return Tagger().fit([(r["text"], r["__y"]) for r in rows], rate)


def tag(docs: DataFrame, tagger: Tagger, least: float = 0.5, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into``: score, and spans, the (start, end) code points of tokens whose marginal reaches ``least``."""
    rows, back = packed(docs, "text")
    at = rows.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    cache: dict[str, float] = {}

    def emissions(tokens: list[str]) -> list[float]:
        """Scores of tokens; a million more where a token ends its sentence."""
        if len(cache) > 500_000:
            cache.clear()
        new = {t for t in tokens if t not in cache}
        if new:
            new = list(new)
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                f = np.array([features(t) for t in part], np.int64)
                e = tagger.weights[f].sum(1, dtype=np.float64) + getattr(tagger, "bias", -20.0)
                cache.update({t: v + (1e6 if t[-1] in ".!?" else 0.0) for t, v in zip(part, e.tolist())})
        return [cache[t] for t in tokens]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scores, spans = [], []
        every = [t or "" for t in batch.column(at).to_pylist()]
        split = [t.split() for t in every]
        for lo, hi in slices(split, SLICE):
            texts, tokens = every[lo:hi], split[lo:hi]
            n = np.array([len(t) for t in tokens])
            x = np.array([v for t in tokens for v in emissions(t)])
            ends = x > 5e5
            e = x - 1e6 * ends
            first = np.cumsum(n) - n
            if len(x):
                ends[(first + n - 1)[n > 0]] = True
                p, _ = marginals(e, *bounds(ends), tagger.trans)
            else:
                p = x
            scores.extend(tagger.score(summary(p, first, n)).tolist())
            for text, a, m in zip(texts, first, n):
                hit = np.flatnonzero(p[a : a + m] >= least)
                found = [x.span() for x in _TOKEN.finditer(text)] if len(hit) else []
                spans.append([{"start": found[k][0], "end": found[k][1]} for k in hit])
        return [pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, span)], names=["score", "spans"])]

    out = with_arrow(rows, run, [T.StructField("found", T.StructType(fields))])
    return out.select(*back(out), F.col("found").alias(into))
