"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over the characters of [A-Za-z0-9+/_=-], one of random strings and one of identifiers, are trained from
labelled samples. A candidate is a maximal run of MIN_RUN or more of those characters outside of base spans (what a base span leaves of a longer
run is a candidate of its own); it is reported as kind markov when its log-likelihood ratio (random over identifier) is above PER_CHAR for each character and above LEAST in all.
Labelled samples: values found by the base patterns and seeded random strings (label 1); ordinary words of the corpus and
joined words as code has them (label 0), from at most SAMPLE_ROWS different documents, those with the smallest hashes of id and text. That bounds
the fit only: every whole text is scanned.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; offsets are code points, end exclusive; repeated rows each
give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import row_key
from spanloom.llm.words import chunks

SAMPLE_ROWS, SAMPLE_STRINGS, MIN_RUN, PER_CHAR, LEAST = 2000, 20_000, 16, 0.8, 12.0
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_HEX = np.zeros(256, dtype=bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_RUN = _CODE >= 0


def runs(mask: np.ndarray, text_ptr: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of least or more; no run crosses from one text to another."""
    step = np.diff(mask.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = text_ptr[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    cut = np.unique(inner[mask[inner] & mask[inner - 1]]) if len(inner) else inner
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    long = end - start >= least
    return start[long], end[long]


def base_spans(data: np.ndarray, text_ptr: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the base matches in all texts, unsorted."""
    found = [(a, b, 2) for a, b in zip(*(x.tolist() for x in runs(_HEX[data], text_ptr, 16)), strict=True)]
    raw, lowered = data.tobytes(), _LOWER[data].tobytes()
    for kind, needles, haystack in ((0, KEYWORDS, lowered), (1, (b"AKIA",), raw)):
        texts: set[int] = set()
        for needle in needles:
            at = haystack.find(needle)
            while at >= 0:
                t = int(np.searchsorted(text_ptr, at, side="right")) - 1
                texts.add(t)
                at = haystack.find(needle, int(text_ptr[t + 1]) - len(needle) + 1 if text_ptr[t + 1] - at > len(needle) else at + 1)
        for t in texts:
            a = int(text_ptr[t])
            for m in (ASSIGN if kind == 0 else ACCESS).finditer(raw[a : int(text_ptr[t + 1])]):
                if (len(m[2]) >= 12) if kind == 0 else (len(m[0]) >= 18):
                    found.append((a + m.start(), a + m.end(), kind))
    return found


class MarkovRatio:
    """Log-likelihood ratio of strings of random characters over ordinary identifiers."""

    def __init__(self, strings: list[str], labels: list[int]):
        size = len(ALPHABET)
        logs = []
        for label in (1, 0):
            counts = np.full((size + 1, size), 0.5)  # row size: the first character
            for s in (s for s, y in zip(strings, labels, strict=True) if y == label):
                codes = _CODE[np.frombuffer(s.encode(), dtype=np.uint8)]
                np.add.at(counts, (np.append(size, codes[:-1]), codes), 1)
            logs.append(np.log(counts / counts.sum(1, keepdims=True)))
        self.ratio = logs[0] - logs[1]

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start))
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            codes = _CODE[data[a:b]]
            out[i] = self.ratio[np.append(len(ALPHABET), codes[:-1]), codes].sum()
        return out


def random_strings(n: int = 3000, seed: int = 7) -> list[str]:
    """Seeded strings over the alphabets in which keys are written."""
    pick = random.Random(seed)
    kinds = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef"]
    return ["".join(pick.choices(kinds[i % len(kinds)], k=pick.randint(16, 48))) for i in range(n)]


#: Words of everyday code and prose, so that a small or foreign corpus still knows ordinary names.
ORDINARY = (
    "get set user account settings name value index count list item file path data time date type size text line word page model class method object error "
    "message request response client server handler factory builder service manager config option default result status state event action update create "
    "delete insert select table column record number string length buffer stream reader writer parser format version release build test check report "
    "source target input output parameter function module package library document section chapter example project directory folder image color width height"
).split()


def joined_words(words: list[str], n: int = 6000, seed: int = 11) -> list[str]:
    """Words joined as identifiers join them: snake_case, kebab-case, camelCase, paths, and a number now and then."""
    pick = random.Random(seed)
    out = []
    for i in range(n if words else 0):
        parts = pick.choices(words, k=pick.randint(1, 4))
        joined = ("_".join(parts), "-".join(parts), "".join(p.capitalize() for p in parts), "/".join(parts), "_".join(parts).upper())[i % 5]
        out.append(joined + (str(pick.randint(0, 2030)) if i % 7 == 0 else ""))
    return out


def strings_of(data: np.ndarray, text_ptr: np.ndarray) -> tuple[set[str], set[str]]:
    """Values found by the base patterns, and the ordinary words beside them."""
    secrets, hidden = set(), np.zeros(len(data), dtype=bool)
    for a, b, kind in base_spans(data, text_ptr):
        hidden[a:b] = True
        value = data[a:b].tobytes()
        secrets.add((ASSIGN.match(value)[2] if kind == 0 else value).decode().replace(".", ""))
    start, end = runs(_RUN[data] & ~hidden, text_ptr, 3)
    short = end - start < MIN_RUN
    words = {data[a:b].tobytes().decode() for a, b in zip(start[short].tolist(), end[short].tolist(), strict=True)}
    return secrets - {""}, {w for w in words if w.isalpha()}


def labelled_samples(secrets: list[str], words: list[str]) -> tuple[list[str], list[int]]:
    """Strings and labels: 1 random, 0 ordinary."""
    rules = [sign * n for sign in "-=_+/" for n in (20, 40, 80)] * 10  # drawn lines
    positive, negative = random_strings() + sorted(secrets), sorted(words) + joined_words(sorted(words)) + joined_words(ORDINARY) + rules
    return positive + negative, [1] * len(positive) + [0] * len(negative)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS, strings: int = SAMPLE_STRINGS) -> MarkovRatio:
    """Fits on the strings of at most rows whole texts; of each label at most strings distinct ones come to the driver."""
    keyed = docs.select(row_key(F.col(id_column), F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(rows)
    texts = keyed.join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ptr in chunks(batch, "text"):
                for label, found in zip((1, 0), strings_of(data, ptr), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([label] * len(found), pa.int32())], names=["string", "label"])

    found = texts.mapInArrow(run, "string string, label int").distinct()
    of = lambda label: [r["string"] for r in found.filter(F.col("label") == label).orderBy(F.xxhash64("string"), "string").limit(strings).collect()]
    return MarkovRatio(*labelled_samples(of(1), of(0)))


def scan_chunk(data: np.ndarray, text_ptr: np.ndarray, model: MarkovRatio | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, kind) of all spans in order of text, start and kind; offsets are code points."""
    spans = base_spans(data, text_ptr)
    if model is not None:
        free = _RUN[data]
        for a, b, _ in spans:
            free[a:b] = False
        start, end = runs(free, text_ptr, MIN_RUN)
        ratio = model.of(data, start, end)
        hit = (ratio > PER_CHAR * (end - start)) & (ratio > LEAST)
        spans += [(a, b, 3) for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
    if not spans:
        return (np.zeros(0, np.int64),) * 4
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    a, b, kind = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    text = np.searchsorted(text_ptr, a, side="right") - 1
    order = np.lexsort((kind, a, text))
    a, b, kind, text = a[order], b[order], kind[order], text[order]
    origin = point[text_ptr[text]]
    return text, point[a] - origin, point[b] - origin, kind


def scan(docs: DataFrame, model: MarkovRatio | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and spans array<struct<kind, start, end>> of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(KINDS, dtype=object)
        for batch in batches:
            for rows, data, ptr in chunks(batch, text_column):
                text, start, end, kind = scan_chunk(data, ptr, shared.value)
                items = pa.StructArray.from_arrays([pa.array(names[kind], pa.string()), pa.array(start), pa.array(end)], names=["kind", "start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(rows.num_rows + 1)).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([rows.column(id_column), lists], names=[id_column, "spans"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, spans array<struct<kind:string,start:long,end:long>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("markov").alias("n_markov"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict = {}
