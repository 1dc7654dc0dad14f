"""Quality rules as a learned decision list.

Sequential covering grows one conjunction of thresholds at a time from the statistics of labelled documents, prunes
it on held-back rows and removes what it covers; the ordered rules become one Spark ``CASE`` expression, so applying
them is a JVM-side projection.

Defined results: a null or empty text has no words and fails the base rule; ties and repeated rows are judged row by
row; rows of labels that repeat an id count once, with their least label; with no usable labels the list is empty and only the base rule decides; texts of any length are counted whole; extra columns
pass through untouched, whatever their names; an empty table gives an empty table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import odd_numbers, packed, texts_of, with_arrow

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
# The symbol characters of the base statistics.
SYMBOLS = b"#*$%&|<>"
#: Rows from which the list is learned at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
FEATURES = {
    "n_words": lambda s: s("n_words"),
    "mean_word": lambda s: s("word_chars") / s("n_words"),
    "symbol_share": lambda s: s("n_symbols") / s("word_chars"),
    "dup_line_share": lambda s: s("n_dup_lines") / s("n_lines"),
    "repeat_share": lambda s: s("n_repeat_words") / s("n_words"),
    "upper_share": lambda s: s("n_upper") / s("word_chars"),
    "digit_share": lambda s: s("n_digits") / s("word_chars"),
    "mark_share": lambda s: s("n_marks") / s("word_chars"),
}
_R = odd_numbers(5, 5)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words which the text holds twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    key = w[:n] * _R[0]
    for k in range(1, 5):
        key += w[k : n + k] * _R[k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 4, np.int64)
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, at, 1)
    np.add.at(twice, at[at + 5 < n + 4] + 5, -1)
    return int((np.cumsum(twice) > 0).sum())


def text_counts(text: bytes) -> list[int]:
    """The statistics of one whole text, in the order of ``COUNTS``."""
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    spaces = int(c[9:14].sum() + c[32])
    points = len(text) - int(c[0x80:0xC0].sum())
    lines = dup = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    marks = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    return [len(words), points - spaces, int(sum(c[x] for x in SYMBOLS)), dup, repeated_words(words), lines, int(c[65:91].sum()), int(c[48:58].sum()), marks]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs``, as :func:`packed` gives it, and ``stats``, a struct column of its texts' statistics."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = np.array([text_counts(t) for t in texts_of(batch)], dtype=np.int64)
        return [pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], names=COUNTS)]

    return with_arrow(docs, run, [T.StructField("stats", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])


def feature(name: str) -> Column:
    """A feature of the list as a column; a share of nothing is 0."""
    return F.coalesce(FEATURES[name](_Safe), F.lit(0.0))


def _Safe(name: str) -> Column:  # noqa: N802
    return F.nullif(F.col(f"stats.{name}"), F.lit(0)).cast("double")


def base_failed() -> Column:
    n, r = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def learning_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample; ``most`` rows reach the driver at most."""
    picked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("__y")).groupBy("doc_id").agg(F.min("__y").alias("__y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).where(~base_failed()).select("doc_id", "__y", *[feature(f).alias(f) for f in FEATURES])
    got = rows.orderBy("doc_id", "__y", *FEATURES).limit(most).toPandas()
    return got[list(FEATURES)].to_numpy(float), got["__y"].to_numpy(int)


def learn(x: np.ndarray, y: np.ndarray, least_precision: float = 0.9, least_rows: int = 3, most_rules: int = 12, most_terms: int = 4) -> list[list[tuple[str, str, float]]]:
    """Sequential covering of the rejected class (label 0). A rule is a list of (feature, operator, threshold)."""
    names, rules = list(FEATURES), []
    if not len(y) or y.min() == y.max():
        return rules
    held = np.arange(len(y)) % 3 == 2
    left, bad = np.ones(len(y), bool), y == 0

    def covers(rule, rows):
        m = rows.copy()
        for f, op, t in rule:
            v = x[:, names.index(f)]
            m &= v >= t if op == ">=" else v <= t
        return m

    for _ in range(most_rules):
        grow, prune = left & ~held, left & held
        rule: list = []
        now = grow
        while len(rule) < most_terms and (now & ~bad).any() and (now & bad).any():
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            best = (1e-9, None, None)
            for k, f in enumerate(names):
                v = x[now, k]
                b = bad[now]
                for t in np.unique(np.quantile(v, np.linspace(0.01, 0.99, 99))):
                    for op, m in ((">=", v >= t), ("<=", v <= t)):
                        p, n = (m & b).sum(), (m & ~b).sum()
                        if p >= least_rows and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0]:
                            best = (gain, (f, op, float(t)), None)
            if best[1] is None:
                break
            rule.append(best[1])
            now = covers(rule, grow)
        if not rule:
            break

        def worth(r):
            m = covers(r, prune)
            return ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule) and precise(covers(rule[:-1], left), bad, least_precision):
            rule = rule[:-1]
        whole = covers(rule, left)
        if (whole & bad).sum() < least_rows or not precise(whole, bad, least_precision) or (covers(rule, prune).any() and not precise(covers(rule, prune), bad, least_precision)):
            break
        rules.append(rule)
        left &= ~whole
        if not (left & bad).any():
            break
    return rules


def precise(rows: np.ndarray, bad: np.ndarray, least: float) -> bool:
    return bool(rows.any()) and (rows & bad).sum() >= least * rows.sum()


def as_column(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered list as one conditional expression: the number of the first rule that holds, else 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        cond = F.lit(True)
        for f, op, t in rule:
            cond = cond & (feature(f) >= F.lit(t) if op == ">=" else feature(f) <= F.lit(t))
        out = F.when(cond, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, into: str = "quality", **how) -> DataFrame:
    """``docs`` with a struct column ``into``: the counts of ``COUNTS``, base_failed, rule (0: none fired) and kept."""
    rules = learn(*learning_rows(docs, labels), **how)
    rows, back = packed(docs, "text")
    found = with_statistics(rows).withColumn("failed", base_failed()).withColumn("rule", as_column(rules))
    verdict = F.struct("stats.*", F.col("failed").alias("base_failed"), "rule", (~F.col("failed") & (F.col("rule") == 0)).alias("kept"))
    return found.select(*back(found), verdict.alias(into))
