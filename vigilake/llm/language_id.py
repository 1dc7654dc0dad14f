"""Language identification as a mixture of languages.

Character n-gram models give every word a likelihood under each language; expectation-maximisation estimates the
proportions of languages in each document, and the set of languages is the one of best penalised likelihood.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no labelled rows everything is
``und``; equal proportions go to the language that sorts first; each row is judged by itself, so repeated rows agree; texts
of any length are read whole; other columns pass through, whatever their names; an empty table gives an empty table.

The model has ORDER tables of SLOTS counts for a language, and a sample bounded in rows and bytes reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, mix64, packed, row_sample, to_driver, with_arrow

#: Labelled rows for each language, n-gram order, hash slots of an order, smoothing, EM steps.
PER_LANGUAGE, ORDER, SLOTS, KAPPA, STEPS = 1500, 4, 1 << 17, 4.0, 12
#: Likelihoods, words times languages, that are mixed at a time; a longer text is mixed alone.
SLICE = 2_000_000
_EDGES = ".,;:!?\"'()[]|#*$%&<>"


def normal(word: str) -> str:
    return word.strip(_EDGES).lower()


def grams(words: list[str], order: int, slots: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of the n-grams that end at each character, for n = 0 to ``order``, and the word of each character."""
    text = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    start = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(start, np.arange(len(c)), 0)) if len(c) else np.zeros(0, np.int64)
    at = np.arange(len(c))
    out, key = [np.zeros(len(c), np.int64)], np.zeros(len(c), np.uint64)
    for n in range(1, order + 1):
        back = at - n + 1
        sym = np.where(back >= begin, c[np.maximum(back, 0)], U64(94))
        key = mix64(key + (sym + U64(n << 32)) * U64(0x9E3779B97F4A7C15))
        out.append((key % U64(slots)).astype(np.int64))
    return out, word


class Model:
    """Interpolated character n-gram counts of each language."""

    def __init__(self, rows: list[tuple[str, str]], order: int = ORDER, slots: int = SLOTS) -> None:
        self.languages = sorted({lang for _, lang in rows})
        self.order, self.slots = order, slots
        self.counts = np.zeros((order + 1, len(self.languages), slots), np.float32)
        self.heads = np.zeros((order + 1, len(self.languages), slots), np.float32)
        for k, lang in enumerate(self.languages):
            words: dict[str, int] = {}
            for text, x in rows:
                if x == lang:
                    for w in map(normal, text.split()):
                        if w:
                            words[w] = words.get(w, 0) + 1
            g, word = grams(list(words), order, slots)
            n = np.array(list(words.values()), float)[word] if words else np.zeros(0)
            for o in range(1, order + 1):
                self.counts[o, k] = np.bincount(g[o], n, slots)
                head = np.concatenate([[0], g[o - 1][:-1]]) if o > 1 and len(word) else g[0]  # the context: what ended one character before
                self.heads[o, k] = np.bincount(head, n, slots)

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """A row of log likelihoods, one for each language, for each word."""
        g, word = grams(words, self.order, self.slots)
        p = np.full((len(self.languages), len(word)), 1 / 500)
        for o in range(1, self.order + 1):
            head = np.concatenate([[0], g[o - 1][:-1]]) if o > 1 else g[0]
            p = (self.counts[o][:, g[o]] + KAPPA * p) / (self.heads[o][:, head] + KAPPA)
        first = np.searchsorted(word, np.arange(len(words)))
        logs = np.log(p)
        logs[:, first] = 0  # the opening mark says nothing
        return np.add.reduceat(logs, first, axis=1).T if len(words) else np.zeros((0, len(self.languages)))


class Words:
    """Likelihoods of words, relative to their best language; remembered up to a bounded number of words."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)

    def look_up(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """Rows of the words of each text, -1 for those without a letter."""
        if len(self.known) > self.most:
            self.clear()
        known, new = self.known, {}
        for text in tokens:
            for w in text:
                if w not in known and w not in new:
                    new[w] = None
        fresh = [w for w in new if any(x.isalpha() for x in w)]
        base = len(self.rows)
        known.update({w: -1 for w in new})
        known.update({w: base + k for k, w in enumerate(fresh)})
        if fresh:
            parts = [self.model.log_likelihoods([normal(w) or w for w in fresh[at : at + 50_000]]) for at in range(0, len(fresh), 50_000)]
            ll = np.concatenate(parts)
            self.rows = np.concatenate([self.rows, np.exp(np.maximum(ll - ll.max(1, keepdims=True), -30)).astype(np.float32)])
        return [np.array([known[w] for w in text], np.int64) for text in tokens]


def proportions(p: np.ndarray, starts: np.ndarray, doc: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over all documents of a batch: (proportions, log likelihood) under the allowed languages."""
    n = np.bincount(doc, minlength=len(starts))[:, None]
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        r = p * pi[doc]
        r /= r.sum(1, keepdims=True) + 1e-30
        pi = np.add.reduceat(r, starts, axis=0) / n
    fit = np.add.reduceat(np.log((p * pi[doc]).sum(1) + 1e-30), starts)
    return pi, fit


def mixtures(p: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, languages in the set) of each document: the set of best penalised likelihood.

    Sets grow by the next language in order of share, up to all. A document is done when no larger set can win: by
    Jensen's inequality no mixture is likelier than the full one by more than n log max_l mean(p_l / mixture), and none
    than the best language of each word."""
    n = np.bincount(doc, minlength=len(starts))
    full, fit = proportions(p, starts, doc, np.ones((len(starts), p.shape[1])), STEPS)
    gain = np.add.reduceat(p / ((p * full[doc]).sum(1, keepdims=True) + 1e-30), starts, axis=0).max(1) / n
    most = np.minimum(fit + n * np.log(np.maximum(gain, 1)), np.add.reduceat(np.log(p.max(1) + 1e-30), starts)) + 1e-6
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    price = 0.5 * np.log(n + 1) + 3
    chosen, size = full.copy(), np.zeros(len(starts), int)
    best, left, at = np.full(len(starts), -np.inf), np.arange(len(starts)), starts
    for k in range(1, p.shape[1] + 1):
        if k > 1:  # those of which a larger set may win
            stay = most[left] - (k - 1) * price[left] > best[left]
            if not stay.all():
                p, left = p[np.repeat(stay, n[left])], left[stay]
                at = np.cumsum(n[left]) - n[left]
                doc = np.repeat(np.arange(len(left)), n[left])
            if not len(left):
                break
        pi, fit = proportions(p, at, doc, (rank[left] < k).astype(float), 0 if k == 1 else 4)
        value = fit - (k - 1) * price[left]
        better = value > best[left]
        won = left[better]
        best[won], chosen[won], size[won] = value[better], pi[better], k
    return chosen, size


def learn(docs: DataFrame) -> Model:
    """docs: labelled rows with doc_id, text and lang. A sample bounded for each language reaches the driver."""
    rows = row_sample(docs.withColumnRenamed("lang", "__lang"), "__lang", PER_LANGUAGE)
    return Model([(r["text"], r["__lang"]) for r in to_driver(rows, "__lang")])


def slices(tokens: list[list[str]], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that hold about ``most`` words together, one at least."""
    lo = size = 0
    for k, t in enumerate(tokens):
        if k > lo and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(tokens):
        yield lo, len(tokens)


def identify(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score, and langs, the set of languages with their proportions."""
    rows, back = packed(docs, "text")
    at = rows.columns.index("text")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.MapType(T.StringType(), T.DoubleType()))]
    state: dict = {}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        words = state.setdefault("words", Words(model))
        names = words.model.languages
        out = [("und", 0.0, [])] * batch.num_rows
        tokens = [(t or "").split() for t in batch.column(at).to_pylist()] if names else []
        for lo, hi in slices(tokens, SLICE // max(1, len(names))):
            rows = words.look_up(tokens[lo:hi])
            rows = [r[r >= 0] for r in rows]
            some = [k for k, r in enumerate(rows) if len(r)]
            if not some:
                continue
            n = np.array([len(rows[k]) for k in some])
            p = words.rows[np.concatenate([rows[k] for k in some])].astype(np.float64)
            pi, size = mixtures(p, np.cumsum(n) - n, np.repeat(np.arange(len(some)), n))
            for k, share, m in zip(some, pi, size):
                order = np.argsort(-share, kind="stable")[:m]
                out[lo + k] = (names[order[0]], float(min(1.0, share[order[0]])), [(names[x], float(share[x])) for x in order])
        pred, score, langs = zip(*out)
        found = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.map_(pa.string(), pa.float64()))]
        return [pa.StructArray.from_arrays(found, names=[f.name for f in fields])]

    out = with_arrow(rows, run, [T.StructField("found", T.StructType(fields))])
    return out.select(*back(out), F.col("found").alias(into))
