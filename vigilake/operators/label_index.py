"""Many terms in many labels by a positional index of words, instead of a pattern for every term over every text.

A label section is a sequence of words (runs of ASCII letters, digits and underscores) and of what stands between them; the
index has a row for each word with its place, its start and the gap after it. A term is such a sequence too. It stands in a
section as whole words where all its words follow one another with its own gaps between them: an equi-join on (drug, word)
and a count by place. Texts are read only to cut the snippets of what was found, and for the few terms that begin or end
with other characters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labels import AROUND, matches, variants

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Stretches that a task holds before it passes them on, and the most bits of :func:`term_bits`.
HELD, MOST_BITS = 200_000, 1 << 27


def spans(text: str) -> list[tuple[int, str, int, str]]:
    """(place, word, start, gap to the next word or the end)."""
    found = list(WORD.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)] * bool(found)
    return [(k, m[0], m.start(), text[m.end() : e]) for k, (m, e) in enumerate(zip(found, ends, strict=True))]


def word_index(texts: DataFrame) -> DataFrame:
    """texts: (drug_name, section, text). (drug_name, section, place, word, start, gap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for drug, section, text in zip(*(b.column(c).to_pylist() for c in ("drug_name", "section", "text")), strict=True):
                rows = spans(text or "")
                for at in range(0, len(rows), 50_000):
                    place, word, start, gap = zip(*rows[at : at + 50_000], strict=True)
                    n = len(place)
                    yield pa.RecordBatch.from_arrays([pa.array([drug] * n, pa.string()), pa.array([section] * n, pa.string()), pa.array(place, pa.int32()), pa.array(word), pa.array(start, pa.int32()), pa.array(gap)], names=["drug_name", "section", "place", "word", "start", "gap"])

    return texts.select("drug_name", "section", "text").mapInArrow(run, "drug_name string, section string, place int, word string, start int, gap string")


def term_words(spellings: DataFrame) -> DataFrame:
    """spellings: (variant), distinct. (variant, k, n, word, offset, gap, outer): its words; ``gap`` is null after the last one,
    ``outer`` tells whether the term begins or ends with other characters. Spellings without a word have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("variant").to_pylist():
                words = spans(v)
                outer = bool(words) and (words[0][2] > 0 or words[-1][3] != "")
                out += [(v, k, len(words), w, start, None if k == len(words) - 1 else gap, outer) for k, w, start, gap in words]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["variant", "k", "n", "word", "offset", "gap", "outer"])

    return spellings.mapInArrow(run, "variant string, k int, n int, word string, offset int, gap string, outer boolean")


def matches_indexed(terms: DataFrame, texts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """:func:`labels.matches` by an index of the texts: (drug_name, pt, section, matched_term, snippet)."""
    index = word_index(texts) if index is None else index
    tried = terms.select("drug_name", "pt", F.posexplode(variants(F.col("pt"))).alias("turn", "variant"))
    words = term_words(tried.select("variant").distinct())
    asked = tried.join(words, "variant").withColumnRenamed("gap", "own_gap")
    met = asked.join(index, ["drug_name", "word"]).where(F.col("own_gap").isNull() | (F.col("own_gap") == F.col("gap")))
    keys = ["drug_name", "pt", "turn", "variant", "section", "outer", "n"]
    placed = met.groupBy(*keys, (F.col("place") - F.col("k")).alias("first"), (F.col("start") - F.col("offset")).alias("at")).agg(F.count("*").alias("words"))
    whole = placed.where((F.col("words") == F.col("n")) & (F.col("at") >= 0))
    # what begins or ends with other characters is held against the text itself
    plain = whole.where(~F.col("outer")).select("drug_name", "pt", "section", "turn", "variant", "at")
    size = F.length("variant")
    edge = lambda c: ~c.rlike("^[A-Za-z0-9_]$")
    checked = whole.where("outer").join(texts, ["drug_name", "section"]).where((F.substring("text", F.col("at") + 1, size) == F.col("variant")) & ((F.col("at") == 0) | edge(F.substring("text", F.col("at"), F.lit(1)))) & edge(F.substring("text", F.col("at") + size + 1, F.lit(1))))
    best = plain.unionByName(checked.select(*plain.columns)).groupBy("drug_name", "pt", "section").agg(F.min(F.struct("turn", "variant", "at")).alias("m"))
    start = F.greatest(F.col("m.at") - AROUND, F.lit(0))
    end = F.least(F.col("m.at") + F.length("m.variant") + AROUND, F.length("text"))
    snippet = F.concat(F.lit("…"), F.substring(F.col("text"), start + 1, end - start), F.lit("…"))
    found = best.join(texts, ["drug_name", "section"]).select("drug_name", "pt", "section", F.col("m.variant").alias("matched_term"), snippet.alias("snippet"))
    # terms none of whose characters is of a word have no row in the index
    wordless = terms.where(~F.exists(variants(F.col("pt")), lambda v: v.rlike("[A-Za-z0-9_]")))
    return found.unionByName(matches(wordless, texts))


def stretches(text: str, shapes: list[tuple[int, int, int]], seam: int | None, bits: bytes, drug: int) -> set[str]:
    """The stretches of a text that are terms of the given shapes if they stand in it as whole words; with ``seam`` only those
    over that place. A shape is (words, other characters before them, other characters after them), or (0, length, 0).

    ``bits`` tells of most stretches that are no term of the drug, by the checksum of the drug (``drug``) and the stretch."""
    found = [m.span() for m in WORD.finditer(text)]
    starts, ends, size, out, mask = [a for a, _ in found], [b for _, b in found], len(text), set(), len(bits) * 8 - 1

    def told(x: str) -> int:
        h = crc32(x.encode("utf-8", "replace"), drug) & mask
        return bits[h >> 3] >> (h & 7) & 1

    for n, before, after in shapes:
        if not n:
            for a, b in zip([0, *ends], [*starts, size], strict=True):  # neither neighbour is of a word
                at = range(a + (a > 0), b - before - (b < size) + 1)
                out.update(text[k : k + before] for k in at if (seam is None or k <= seam < k + before) and told(text[k : k + before]))
            continue
        whole = zip(starts, ends[n - 1 :])
        if before or after:
            past, to_come = [-1, *ends], [*starts[n:], size + 1]
            whole = [(a - before, b + after) for (a, b), p, t in zip(whole, past, to_come) if a - before > p - (not before) and b + after < t + (not after)]
        if seam is not None:
            whole = [(a, b) for a, b in whole if a <= seam < b]
        for a, b in whole:  # told(), spelt out
            x = text[a:b]
            h = crc32(x.encode("utf-8", "replace"), drug) & mask
            if bits[h >> 3] >> (h & 7) & 1:
                out.add(x)
    return out


def term_bits(terms: DataFrame, n: int) -> bytes:
    """terms: (drug_name, variant), some ``n`` of them. A bit for each by its checksum, 16 bits a term and 16 MB at most: what has
    no bit is no term, what has one may be."""
    size = min(max(1 << 15, 1 << (16 * n).bit_length()), MOST_BITS)
    at = terms.select((F.crc32(F.concat("drug_name", "variant")) % size + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(out)


def matches_in_labels(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`labels.matches` on the texts that :func:`labels.sections` would make of ``labels`` (drug_name, label, section,
    text): (drug_name, pt, section, matched_term). No section is put together: a label's stretches of as many words as a term
    meet the terms by an equi-join, and what runs over the ends of labels is read from those ends. Null texts are left out."""
    tried = terms.select("drug_name", "pt", F.posexplode(variants(F.col("pt"))).alias("turn", "variant"))
    words = F.regexp_count("variant", F.lit("[A-Za-z0-9_]+"))
    lead, tail = F.length(F.regexp_extract("variant", "^[^A-Za-z0-9_]*", 0)), F.length(F.regexp_extract("variant", "[^A-Za-z0-9_]*$", 0))
    shape = tried.select(words.alias("n"), lead.alias("before"), F.when(words > 0, tail).otherwise(0).alias("after"), F.length("variant").alias("size"))
    told = shape.groupBy("n", "before", "after").agg(F.max("size").alias("size"), F.count("*").alias("terms")).collect()  # numbers alone
    shapes, reach = sorted((r["n"], r["before"], r["after"]) for r in told), max((r["size"] for r in told), default=0) + 1
    bits = term_bits(tried.where("drug_name IS NOT NULL"), sum(r["terms"] for r in told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[str, str, str]] = set()

        def passed() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["drug_name", "section", "stretch"])

        for b in batches:
            for drug, section, text, seam in zip(*(b.column(c).to_pylist() for c in ("drug_name", "section", "text", "seam")), strict=True):
                held.update((drug, section, x) for x in stretches(text, shapes, seam, bits, crc32(drug.encode("utf-8", "replace"))))
                if len(held) > HELD:
                    yield passed()
                    held.clear()
        yield passed()

    rows = labels.where("text IS NOT NULL AND drug_name IS NOT NULL").select("drug_name", "section", "label", F.lower("text").alias("text"))
    inside = rows.select("drug_name", "section", "text", F.lit(None).cast("int").alias("seam"))
    # a label's end and the starts of those after it, as far as a term reaches; of long texts only the ends take room
    ends = rows.select("drug_name", "section", "label", F.left("text", F.lit(reach)).alias("head"), F.right("text", F.lit(reach)).alias("tail"), (F.least(F.length("text"), F.lit(2 * reach)) + 1).cast("long").alias("room"))
    one = W.partitionBy("drug_name", "section")
    line = one.orderBy("label", "head", "tail", "room")
    placed = ends.withColumn("at", F.sum("room").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("room"))
    next_ = F.collect_list(F.struct("at", "head")).over(one.orderBy("at").rangeBetween(1, 3 * reach + 1))
    seams = placed.withColumn("next", next_).where("size(next) > 0").withColumn("ahead", F.left(F.array_join(F.transform(F.array_sort("next"), lambda x: x["head"]), " "), F.lit(reach)))
    over = seams.select("drug_name", "section", F.concat("tail", F.lit(" "), "ahead").alias("text"), F.length("tail").alias("seam"))
    kinds = "drug_name string, section string, stretch string"
    found = inside.mapInArrow(run, kinds).unionByName(over.mapInArrow(run, kinds))
    met = tried.join(found.withColumnRenamed("stretch", "variant"), ["drug_name", "variant"])
    return met.groupBy("drug_name", "pt", "section").agg(F.min(F.struct("turn", "variant")).alias("m")).select("drug_name", "pt", "section", F.col("m.variant").alias("matched_term"))
