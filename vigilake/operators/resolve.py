"""Names of drugs as people write them, resolved to names in the data."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import settle

# Brand names and their substances.
BRANDS = {
    "TACHIPIRINA": "ACETAMINOPHEN", "EFFERALGAN": "ACETAMINOPHEN", "PANADOL": "ACETAMINOPHEN", "TYLENOL": "ACETAMINOPHEN", "ACET": "ACETAMINOPHEN",
    "PARACETAMOLO": "ACETAMINOPHEN", "BRUFEN": "IBUPROFEN", "MOMENT": "IBUPROFEN", "NUROFEN": "IBUPROFEN", "ADVIL": "IBUPROFEN", "IBUPROFENE": "IBUPROFEN",
    "ASPIRINA": "ASPIRIN", "ASPIRINE": "ASPIRIN", "CARDIOASPIRINA": "ASPIRIN", "CARDIOASPIRIN": "ASPIRIN", "BAYER": "ASPIRIN", "VOLTAREN": "DICLOFENAC",
    "VOLTAROL": "DICLOFENAC", "DICLOREUM": "DICLOFENAC", "DICLOFENACO": "DICLOFENAC", "KETOPROFENE": "KETOPROFEN", "ORUDIS": "KETOPROFEN", "FASTUM": "KETOPROFEN",
    "LASIX": "FUROSEMIDE", "LOSEC": "OMEPRAZOLE", "PRILOSEC": "OMEPRAZOLE", "NEXIUM": "ESOMEPRAZOLE", "PANTORC": "PANTOPRAZOLE", "PARIET": "RABEPRAZOLE",
    "LIPITOR": "ATORVASTATIN", "ZOCOR": "SIMVASTATIN", "CRESTOR": "ROSUVASTATIN", "PRAVACHOL": "PRAVASTATIN", "NORVASC": "AMLODIPINE", "ZESTRIL": "LISINOPRIL",
    "PRINIVIL": "LISINOPRIL", "COVERSYL": "PERINDOPRIL", "TRITACE": "RAMIPRIL", "DIOVAN": "VALSARTAN", "COZAAR": "LOSARTAN", "TENORMIN": "ATENOLOL",
    "CONCOR": "BISOPROLOL", "AUGMENTIN": "AMOXICILLIN", "ZIMOX": "AMOXICILLIN", "ZITHROMAX": "AZITHROMYCIN", "KLACID": "CLARITHROMYCIN", "CIPROXIN": "CIPROFLOXACIN",
    "FLAGYL": "METRONIDAZOLE", "GLUCOPHAGE": "METFORMIN", "JANUVIA": "SITAGLIPTIN", "LANTUS": "INSULIN GLARGINE", "HUMALOG": "INSULIN LISPRO", "NOVOLOG": "INSULIN ASPART",
    "COUMADIN": "WARFARIN", "SINTROM": "ACENOCOUMAROL", "PRADAXA": "DABIGATRAN", "XARELTO": "RIVAROXABAN", "ELIQUIS": "APIXABAN", "DELTACORTENE": "PREDNISONE",
    "MEDROL": "METHYLPREDNISOLONE", "BENTELAN": "BETAMETHASONE", "HERCEPTIN": "TRASTUZUMAB", "AVASTIN": "BEVACIZUMAB", "GLEEVEC": "IMATINIB", "GLIVEC": "IMATINIB",
    "TAXOL": "PACLITAXEL", "TAXOTERE": "DOCETAXEL", "XELODA": "CAPECITABINE", "ZOMETA": "ZOLEDRONIC ACID", "NEUPOGEN": "FILGRASTIM", "KEYTRUDA": "PEMBROLIZUMAB",
    "OPDIVO": "NIVOLUMAB", "PROGRAF": "TACROLIMUS", "SANDIMMUN": "CICLOSPORIN", "CELLCEPT": "MYCOPHENOLATE MOFETIL", "LYRICA": "PREGABALIN", "NEURONTIN": "GABAPENTIN",
    "ZOLOFT": "SERTRALINE", "PROZAC": "FLUOXETINE", "LEXAPRO": "ESCITALOPRAM", "CIPRALEX": "ESCITALOPRAM", "RISPERDAL": "RISPERIDONE", "ZYPREXA": "OLANZAPINE",
    "SEROQUEL": "QUETIAPINE", "XANAX": "ALPRAZOLAM", "VALIUM": "DIAZEPAM", "TAVOR": "LORAZEPAM", "RIVOTRIL": "CLONAZEPAM", "DEPAKINE": "VALPROIC ACID",
    "TEGRETOL": "CARBAMAZEPINE", "KEPPRA": "LEVETIRACETAM", "VENTOLIN": "ALBUTEROL", "SALBUTAMOLO": "ALBUTEROL", "SYMBICORT": "BUDESONIDE", "SERETIDE": "FLUTICASONE",
    "SPIRIVA": "TIOTROPIUM", "SINGULAR": "MONTELUKAST", "DIFLUCAN": "FLUCONAZOLE", "TAMIFLU": "OSELTAMIVIR", "PLAVIX": "CLOPIDOGREL", "NEXPLANON": "ETONOGESTREL",
}
#: The least similarity of a fuzzy match, out of 100.
LEAST = 75.0


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BRANDS.items()), "brand string, inn string")


def brand_lookup(names: DataFrame, table: DataFrame, whole_words: bool = True) -> DataFrame:
    """names: (query). Adds ``inn``: of the brand that is the whole name, else of the longest brand that begins it as a word.

    Without ``whole_words``, else of the first brand of the table that begins it at all, as some front-ends expect it."""
    q = names.where("query IS NOT NULL").select("query", F.upper(F.trim("query")).alias("clean")).distinct()
    if whole_words:
        by_word = q.withColumn("brand", F.explode(F.expr("transform(sequence(1, size(split(clean, ' '))), k -> array_join(slice(split(clean, ' '), 1, k), ' '))")))
        hit = by_word.join(F.broadcast(table), "brand").groupBy("query").agg(F.max_by("inn", F.length("brand")).alias("inn"))  # a fixed table of about a hundred rows
    else:
        turn = F.create_map(*[F.lit(x) for k, v in enumerate(BRANDS) for x in (v, k)])
        by_start = q.withColumn("brand", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("clean"), F.lit(1))), lambda k: F.substring(F.col("clean"), F.lit(1), k))))
        found = by_start.join(F.broadcast(table), "brand")  # a fixed table of about a hundred rows
        hit = found.groupBy("query").agg(F.min_by("inn", F.when(F.col("brand") == F.col("clean"), -1).otherwise(turn[F.col("brand")])).alias("inn"))
    return names.join(hit, "query", "left")


#: Letters that a machine word holds; longer names take Python's integers.
WORD = 64


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, bit-parallel: a bit for each letter of ``a``, a step for each of
    ``b``, all pairs at once."""
    out = np.zeros(len(a), dtype=np.int64)
    short = np.array([0 < len(x) <= WORD and len(y) > 0 for x, y in zip(a, b, strict=True)], dtype=bool)
    for k in np.flatnonzero(~short):
        out[k] = common_length(a[k], b[k])
    some = np.flatnonzero(short)
    if len(some):
        letter = {c: k for k, c in enumerate(sorted({c for k in some for c in b[k]}))}
        names = {x: k for k, x in enumerate(dict.fromkeys(a[k] for k in some))}
        masks = np.zeros((len(names), len(letter) + 1), dtype=np.uint64)  # the last letter is none
        for x, row in names.items():
            for k, c in enumerate(x):
                if c in letter:
                    masks[row, letter[c]] |= np.uint64(1 << k)
        width = max(len(b[k]) for k in some)
        steps = np.array([[letter[c] for c in b[k]] + [len(letter)] * (width - len(b[k])) for k in some])
        row, size = np.array([names[a[k]] for k in some]), np.array([len(a[k]) for k in some], dtype=np.uint64)
        v = np.full(len(some), np.iinfo(np.uint64).max, dtype=np.uint64)
        for t in range(width):
            u = v & masks[row, steps[:, t]]
            v = (v + u) | (v - u)
        low = np.iinfo(np.uint64).max >> (np.uint64(WORD) - size)
        out[some] = np.bitwise_count(~v & low)
    return out


def common_length(a: str, b: str) -> int:
    """One pair's, over integers of any length."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of pairs of names as sets of words, out of 100: common words against each side's whole, the best of the pairings.

    Two texts' ratio is twice their common subsequence over both lengths; common words begin each whole, so that theirs is
    known without one."""
    scores, sides, at = np.zeros(len(a)), [], []
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = set(p.split()), set(q.split())
        if not x or not y:
            continue
        both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and (not left or not right):
            scores[k] = 100.0
            continue
        one, two = (" ".join(filter(None, (both, s))) for s in (left, right))
        if both:
            scores[k] = max(200.0 * len(both) / (len(both) + len(w)) for w in (one, two))
        sides.append((one, two))
        at.append(k)
    if at:
        one, two = (list(s) for s in zip(*sides, strict=True))
        ratio = 200.0 * common_lengths(one, two) / np.array([len(p) + len(q) for p, q in sides])
        scores[at] = np.maximum(scores[at], ratio)
    return scores


def token_set_ratio(a: str, b: str) -> float:
    return float(token_set_ratios([a], [b])[0])


#: Tokens whose frequencies set the order of letters, keys of one name and length beyond which a key is one letter.
TOKENS, KEYS = 5_000, 64


def spelled(name: str) -> str:
    """A name's different words in order."""
    return " ".join(sorted(set(name.split())))


def letters(text: str) -> list[tuple[str, int]]:
    """Letters with their turn: the second E of a name is (E, 2)."""
    turn: Counter = Counter()
    out = []
    for c in text:
        turn[c] += 1
        out.append((c, turn[c]))
    return out


def least_common(m: int, n: int, least: float) -> int:
    """Letters that two names of these lengths share at least where the ratio of their wholes reaches ``least``."""
    return max(1, math.ceil(least * (m + n) / 200 - 1e-9))


def letter_keys(ordered: list, own: int, other: int, least: float) -> Iterator[tuple]:
    """Keys of a name of ``own`` letters, rarest first, towards names of ``other`` letters.

    Names with t letters in common share j of them among the first (length - t + j) of each, in one order for all: of those
    every choice of j is a key. j is two where that makes few keys on both sides, else one."""
    t = least_common(own, other, least)
    if t > min(own, other):
        return
    j = min(2, t)
    if j == 2 and math.comb(max(own, other) - t + 2, 2) > KEYS:
        j = 1
    yield from combinations(ordered[: own - t + j], j)


def key_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def word_rows(names: DataFrame, least: float) -> DataFrame:
    """(side, name, word, probe): all words of names, and which of them probe the other side's.

    Common words decide a score alone only if they weigh ``least / (200 - least)`` of a side's whole; of a side's words, the
    rarest first, those probe after which the rest weighs less."""
    share = least / (200.0 - least)
    words = names.select("side", "name", F.explode("words").alias("word"))
    often = words.where("side = 1").groupBy("word").agg(F.count("*").alias("often"))
    every = words.join(often, "word", "left").withColumn("weight", F.length("word") + 1)
    whole = W.partitionBy("side", "name")
    left = F.sum("weight").over(whole.orderBy(F.coalesce("often", F.lit(0)), "word").rowsBetween(W.currentRow, W.unboundedFollowing))
    return every.withColumns({"left": left, "all": F.sum("weight").over(whole)}).select("side", "name", "word", (F.col("left") >= share * (F.col("all") - 1) + 1 - 1e-9).alias("probe"))


def candidates(names: DataFrame, index: DataFrame, least: float = LEAST) -> DataFrame:
    """(query, drug_name) of all pairs that may reach ``least``, from two inverted indexes and no others.

    Words: what :func:`word_rows` says. Letters: a whole's ratio cannot pass twice the letters in common over both lengths,
    so lengths and the rarest letters (:func:`letter_keys`) tell which names can meet at all; of those that do, letters are
    counted out (:func:`may_reach`)."""
    both = names.where("query IS NOT NULL").select(F.lit(0).alias("side"), F.col("query").alias("name")).unionByName(index.where("drug_name IS NOT NULL").select(F.lit(1).alias("side"), F.col("drug_name").alias("name"))).distinct()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(set(x.split())) for x in b.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("side"), b.column("name"), pa.array(words, type=pa.list_(pa.string())), pa.array([len(" ".join(w)) for w in words], type=pa.int32())], names=["side", "name", "words", "size"])

    both = settle(both.mapInArrow(spell, "side int, name string, words array<string>, size int").where("size > 0"))
    # one number a length that occurs, and the commonest letters with their turns: both bounded, whatever the names are
    lengths = {0: [], 1: []}
    for r in both.groupBy("side", "size").count().collect():
        lengths[r["side"]].append(r["size"])
    turns = both.where("side = 1").mapInArrow(_turns, "token string")
    often = {r["token"]: r["count"] for r in turns.groupBy("token").count().orderBy(F.desc("count"), "token").limit(TOKENS).collect()}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for side, name, words in zip(*(b.column(c).to_pylist() for c in ("side", "name", "words")), strict=True):
                text = " ".join(words)
                ordered = sorted((often.get(f"{c}{k}", 0), c, k) for c, k in letters(text))
                for other in lengths[1 - side]:
                    ends = (len(text), other) if side == 0 else (other, len(text))
                    rows += [(side, name, key_of(*ends, *k)) for k in letter_keys(ordered, len(text), other, least)]
            for at in range(0, len(rows), 100_000):
                side, name, key = zip(*rows[at : at + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(side, type=pa.int32()), pa.array(name), pa.array(key)], names=["side", "name", "key"])

    made = both.mapInArrow(keys, "side int, name string, key long")
    one, two = (made.where(f"side = {k}").select("key", F.col("name").alias(c)) for k, c in ((0, "query"), (1, "drug_name")))
    by_letters = one.join(two, "key").select("query", "drug_name")
    word = word_rows(both, least)
    x, y = (word.where(f"side = {k}").select("word", F.col("name").alias(c), F.col("probe").alias(f"p{k}")) for k, c in ((0, "query"), (1, "drug_name")))
    by_words = x.join(y, "word").where("p0 OR p1").select("query", "drug_name")
    return by_letters.union(by_words).distinct().where(_may_reach(F.lit(float(least)), "query", "drug_name"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([f"{c}{k}" for w in b.column("words").to_pylist() for c, k in letters(" ".join(w))], type=pa.string())], names=["token"])


@F.pandas_udf(T.BooleanType())
def _may_reach(least: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([may_reach(x, y, t) for t, x, y in zip(least, a, b, strict=True)], dtype=bool)


def may_reach(a: str, b: str, least: float) -> bool:
    """Whether two names' common words weigh enough, or else the letters that they have in common are as many as the ratio of
    their wholes needs."""
    one, two = spelled(a), spelled(b)
    both = " ".join(set(one.split()) & set(two.split()))
    if both and (200.0 - least) * len(both) >= least * min(len(one), len(two)) - 1e-6:
        return True
    return (Counter(one) & Counter(two)).total() >= least_common(len(one), len(two), least)


def fuzzy(names: DataFrame, index: DataFrame, least: float = LEAST) -> DataFrame:
    """names: (query), distinct; index: (drug_name), distinct. The most similar name of each query, if similar enough; of
    equally similar ones the first in order.

    Only the pairs of :func:`candidates` are scored, which are all that can reach ``least``."""
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(token_set_ratios(a.tolist(), b.tolist()))

    q = names.where("query IS NOT NULL").select("query", F.upper(F.trim("query")).alias("clean"))
    scored = candidates(q.select(F.col("clean").alias("query")), index, least).withColumn("score", score("query", "drug_name")).where(F.col("score") >= least)
    best = scored.groupBy(F.col("query").alias("clean")).agg(F.min(F.struct((-F.col("score")).alias("s"), "drug_name")).alias("m"))
    return q.join(best, "clean").select("query", F.col("m.drug_name").alias("match"), (-F.col("m.s")).alias("score"))


def resolve(names: DataFrame, index: DataFrame, table: DataFrame, ask: Callable[[str], str | None] | None = None, whole_words: bool = True) -> DataFrame:
    """(query, name, method, score, via) of every different query that is not null.

    In this order: the substance of its brand, if the index has it or a name like it; the name itself in the index; a name of
    the index like it; what ``ask`` (none by default) makes of it, if the index has a name like that; else as it is written.
    ``method`` is exact, fuzzy, asked or passthrough, ``via`` what led there: brand, name or ask."""
    n = names.where("query IS NOT NULL").select("query").distinct()
    n = brand_lookup(n, table, whole_words).withColumn("clean", F.upper(F.trim("query")))
    asked = F.udf(lambda q: ask(q))("query") if ask is not None else F.lit(None).cast("string")
    known = index.where("drug_name IS NOT NULL").select("drug_name").distinct()

    def sought(rows: DataFrame, column: str) -> DataFrame:
        """Adds ``name``, ``score`` and ``method`` of what the index has for a column."""
        x = rows.join(known.withColumnRenamed("drug_name", "exact"), F.col(column) == F.col("exact"), "left")
        like = fuzzy(x.where(F.col("exact").isNull() & F.col(column).isNotNull()).select(F.col(column).alias("query")).distinct(), known)
        x = x.join(like.select(F.col("query").alias("asked_for"), "match", F.col("score").alias("like")), F.col(column) == F.col("asked_for"), "left").drop("asked_for")
        method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("match").isNotNull(), "fuzzy")
        return x.withColumns({"name": F.coalesce("exact", "match"), "score": F.when(F.col("exact").isNotNull(), 100.0).otherwise(F.col("like")), "method": method}).drop("exact", "match", "like")

    out, rest = None, n
    for column, via in (("inn", "brand"), ("clean", "name"), ("asked", "ask")):
        if column == "asked":
            rest = rest.withColumn("asked", F.upper(F.trim(asked)))
        tried = sought(rest, column)
        method = F.when(F.lit(via == "ask"), F.lit("asked")).otherwise(F.col("method"))
        part = tried.where("name IS NOT NULL").select("query", "name", method.alias("method"), "score", F.lit(via).alias("via"))
        out = part if out is None else out.unionByName(part)
        rest = tried.where("name IS NULL").select("query", "inn", "clean")
        if column == "clean" and ask is None:
            break
    return out.unionByName(rest.select("query", F.col("clean").alias("name"), F.lit("passthrough").alias("method"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("via")))
