"""Secret scans: fixed patterns, and zstandard novelty for strings that no pattern knows.

A candidate string near a sensitive word is compressed after its surrounding code, with a dictionary of the corpus's
identifiers primed into the compressor. The bytes it adds measure how little the surroundings and known identifiers
explain it; strings that hardly compress are reported as ``novel``. Candidates and their copies explain nothing, neither
in the dictionary nor as context; only words of theirs that stand elsewhere too are left in the context.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; each row is scanned by
itself, so repeated rows and ties change nothing; texts of any length are scanned whole; other columns pass through,
whatever their names; an empty table gives an empty table."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, with_arrow

# The patterns and kinds of the base scan.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more
KINDS = ["assign", "access", "hex", "novel"]
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# Words that make a context sensitive for the novelty scan.
SENSITIVE = re.compile(r"(?i:passw|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|auth_|authorization|bearer|credential|signature|akia)", re.ASCII)
SENSITIVE_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "access", "private", "auth", "bearer", "credential", "signature", "akia")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")
CORE = re.compile(r"[A-Za-z0-9+/_~-]{16,}")  # what copies of a candidate share, without name= and padding
WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{3,}(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+")
#: Characters of context on each side, reach of a sensitive word, identifiers in the dictionary, and the share of a candidate's bytes that must be new.
CONTEXT, REACH, IDENTIFIERS, NOVEL = 256, 48, 2048, 0.6


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def mixed(word: str) -> bool:
    return any(x.isdigit() for x in word) and any(x.isalpha() for x in word)


def candidates(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of whole strings that mix letters and digits and begin, end or lie within reach of a sensitive word on either side."""
    if not any(h in low for h in SENSITIVE_HINTS):
        return []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    ends = [e for _, e in words]
    found = []
    for c in CANDIDATE.finditer(text):
        first = bisect_left(ends, c.start() - REACH)  # words before it end out of reach
        if first < len(words) and words[first][0] <= c.end() + REACH and mixed(c[0]):
            found.append(c.span())
    return found


def heads(text: str, start: int, end: int) -> list[int]:
    """Where a candidate may begin: at its start, or at a sensitive word inside of it, so that what stands before does not dilute it."""
    return [start] + [at for m in SENSITIVE.finditer(text, start, end) if (at := m.start()) > start and end - at >= 16 and mixed(text[at:end])]


def veiled(text: str, found: list[tuple[int, int]], known: frozenset[str] | None = None) -> str:
    """``text`` with blanks for the candidates and for strings equal to one of them; offsets stay.

    With ``known``, words of theirs stay that are in ``known`` or stand in the text outside of all of them."""
    keys = {x for s, e in found for x in (text[s:e], *CORE.findall(text[s:e]))}
    hide = list(found)
    for run in CANDIDATE.finditer(text):
        if run[0] in keys:
            hide.append(run.span())
        else:
            hide += [(run.start() + c.start(), run.start() + c.end()) for c in CORE.finditer(run[0]) if c[0] in keys]
    merged: list[list[int]] = []
    for s, e in sorted(hide):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, at = [], 0
    for s, e in merged:
        out += [text[at:s], "\x20" * (e - s)]
        at = e
    blank = "".join([*out, text[at:]])
    if known is None:
        return blank
    words = known.union(WORD.findall(blank))
    for k, (s, e) in enumerate(merged):
        out[2 * k + 1] = PART.sub(lambda m: m[0] if m[0] in words else "\x20" * len(m[0]), text[s:e])
    return "".join([*out, text[at:]])


class Novelty:
    """Marginal compressed size of strings after their context, under one primed dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        self.zstd = zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.words = frozenset(WORD.findall(dictionary.decode()))

    def share(self, text: str, start: int, end: int, veil: str | None = None) -> float:
        """``veil`` is the text as context: with all candidates veiled, by default this one."""
        veil = veiled(text, [(start, end)], self.words) if veil is None else veil
        word = text[start:end]
        before, after = (x.replace(word, "\x20").encode() for x in (veil[max(0, start - CONTEXT) : start], veil[end : end + CONTEXT]))
        context = after + b" " + before
        return (len(self.zstd.compress(context + word.encode())) - len(self.zstd.compress(context))) / len(word)


def spans(text: str, novelty: Novelty) -> list[tuple[int, int, int]]:
    low = text.lower()
    found = base_spans(text, low)
    near = candidates(text, low)
    if near:
        veil = veiled(text, near, novelty.words)
        for s, e in near:
            new = next((at for at in heads(text, s, e) if novelty.share(text, at, e, veil) >= NOVEL), None)
            if new is not None:
                found.append((new, 3, e))
    return sorted(set(found))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def identifier_dictionary(docs: DataFrame, most: int = IDENTIFIERS) -> bytes:
    """The identifiers around candidates that most distinct texts hold, over all rows; at most ``most`` of 32 bytes reach the driver.

    Candidates and their copies are no identifiers, and copies of a text count once."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text in batch.column(0).to_pylist():
            words: set[str] = set()
            near = candidates(text, text.lower()) if text else []
            if near:
                veil = veiled(text, near)
                for s, e in near:
                    words.update(IDENTIFIER.findall(veil[max(0, s - CONTEXT) : s]), IDENTIFIER.findall(veil[e : e + CONTEXT]))
            out.append(sorted(words))
        return [pa.array(out, pa.list_(pa.string()))]

    texts = docs.select(F.col("text").alias("__text"), F.xxhash64("text").alias("__of"))
    seen = with_arrow(texts, run, [T.StructField("__words", T.ArrayType(T.StringType()))])
    held = seen.select(F.explode("__words").alias("w"), "__of").distinct()
    top = held.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    # what a compressor sees last it refers to most cheaply
    return " ".join(r["w"] for r in reversed(top.collect())).encode()


def scan(docs: DataFrame, dictionary: bytes | None = None, redact: str | None = None, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``, an array of (kind, start, end); with ``redact``, each covered stretch of the text becomes that string."""
    words = identifier_dictionary(docs) if dictionary is None else dictionary
    rows, back = packed(docs, "text")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    at = rows.columns.index("text")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        novelty = Novelty(words)
        rows, texts = [], []
        for text in batch.column(at).to_pylist():
            found = spans(text, novelty) if text else []
            rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            texts.append(replaced(text, found, redact) if redact is not None and found else text)
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        out = [pa.array(rows, spans_type)]
        return [*out, pa.array(texts, pa.string())] if redact is not None else out

    fields = [T.StructField("found", kind)] + ([T.StructField("cleaned", T.StringType())] if redact is not None else [])
    out = with_arrow(rows, run, fields)
    return out.select(*back(out, **({"text": F.col("cleaned")} if redact is not None else {})), F.col("found").alias(into))


def replaced(text: str, found: list[tuple[int, int, int]], by: str) -> str:
    """``text`` with overlapping spans merged and each replaced once."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in found:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], by]
        at = e
    return "".join([*out, text[at:]])


def digest(found: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(written(found).encode()).hexdigest()
