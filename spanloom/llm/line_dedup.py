"""Line deduplication by a log-template tree.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its first DEPTH tokens, where a token that holds a digit or
an at sign is a variable <*>. A leaf holds any number of templates. Its distinct lines are taken in the order of their first places. A line fits a template if it
agrees with it in at least SIMILAR of its tokens, one by one, where a variable agrees with any token, and if at least CONSTANT of the tokens would stay constant. It joins the
template that it agrees with in most tokens (of equal ones, the earliest), and every token in which it differs becomes a variable of it; a line that fits none founds a
template. A line of variables only is its own template, unmasked. The outcome depends on ids and texts alone, not on the order of rows.

Tokens are read again for lines whose leaf holds several distinct ones, by way of a bitmap of leaf hashes of fixed size; what it lets
through besides falls out in the join. The distinct lines of a leaf meet in one task; in a large leaf a line is compared only with templates that share a part of the line with it or
have a variable there. There is one part more than tokens may differ, so that no template that fits is passed over.

A template that recurs across documents is dropped everywhere but at its first place (smallest id, then first line), so that one copy of
every passage stays. Lines of fewer than MIN_TOKENS tokens are left alone.

Defined cases: a null text stays null and has no lines, an empty one stays empty; if all lines of a text go, it becomes empty; rows with the same
id and text are one document and decided alike; a null id is an id of its own, before all others; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import row_key, scratch, written
from spanloom.llm.skew import join_unique
from spanloom.llm.words import U, chunks, list_hashes, mix, split_words

DEPTH, FIELDS, SIMILAR, CONSTANT, MIN_TOKENS = 3, 8, 0.75, 0.5, 3  # FIELDS: for the brute force of the tests alone
#: Words of 64 bits in the bitmap of leaves; distinct lines from which on a leaf is searched by parts.
BITMAP_WORDS, LARGE = 1 << 19, 512
_VARIABLE = np.zeros(256, dtype=bool)
_VARIABLE[[*range(0x30, 0x3A), 0x40]] = True
_STAR = U(0x5851F42D4C957F2D)


def parse_lines(data: np.ndarray, text_ptr: np.ndarray) -> dict[str, np.ndarray]:
    """text, line, tokens, leaf, exact and place (begin, among the hashes masked of all words) of each line that has MIN_TOKENS or more."""
    words = split_words(data, text_ptr)
    plain = words.hashes()
    marks = np.concatenate([[0], np.cumsum(_VARIABLE[data])])
    masked = np.where(marks[words.end] > marks[words.start], _STAR, plain)
    breaks = np.flatnonzero(data == 0x0A)
    owner = words.owner()
    line = np.searchsorted(breaks, words.start)  # line breaks before the word, over the whole chunk
    new = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))) if len(line) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(line)).astype(np.int64) if len(new) else new
    long = end - new >= MIN_TOKENS
    new, end = new[long], end[long]
    n = end - new
    text = owner[new]
    stars = np.concatenate([[0], np.cumsum(masked == _STAR)])
    only = stars[end] - stars[new] == n
    exact = np.where(only, list_hashes(plain, new, end, 3), list_hashes(masked, new, end))
    head = new + np.minimum(n, DEPTH)
    leaf = mix(list_hashes(masked, new, head) + n.astype(U) * U(0x9E3779B97F4A7C15))
    leaf = np.where(only, exact, leaf)
    return {"text": text, "line": line[new] - np.searchsorted(breaks, text_ptr[text]), "tokens": n, "leaf": leaf, "exact": exact, "begin": new, "masked": masked}


def line_rows(docs: DataFrame) -> DataFrame:
    """key, id, line, leaf and exact of each line; docs has dedup_key, id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, "text"):
                x = parse_lines(data, ptr)
                at = pa.array(x["text"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("dedup_key").take(at), rows.column("id").take(at), pa.array(x["line"].astype(np.int32)), pa.array(x["leaf"].view(np.int64)), pa.array(x["exact"].view(np.int64))],
                    names=["dedup_key", "id", "line", "leaf", "exact"],
                )

    return docs.mapInArrow(run, f"dedup_key binary, id {dict(docs.dtypes)['id']}, line int, leaf long, exact long")


def leaf_bitmap(leaves: DataFrame) -> np.ndarray:
    """BITMAP_WORDS words with the bits of the leaves set."""
    word, bit = F.shiftrightunsigned("leaf", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)), F.expr("shiftleft(1L, cast(leaf & 63 as int))")
    found = leaves.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_WORDS, dtype=U)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return bitmap


def token_rows(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, exact and tokens (hashes) of the distinct lines of each slice of text that fall into the leaves, and of a few others."""
    bitmap = docs.sparkSession.sparkContext.broadcast(leaf_bitmap(leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ptr in chunks(batch, "text"):
                x = parse_lines(data, ptr)
                leaf = x["leaf"]
                at = np.flatnonzero((bitmap.value[(leaf >> U(6)) & U(BITMAP_WORDS - 1)] >> (leaf & U(63))) & U(1))
                at = at[np.unique(x["exact"][at], return_index=True)[1]]
                n = x["tokens"][at]
                bounds = np.concatenate([[0], np.cumsum(n)])
                tokens = x["masked"][np.arange(bounds[-1]) + np.repeat(x["begin"][at] - bounds[:-1], n)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at].view(np.int64)), pa.array(x["exact"][at].view(np.int64)), lists], names=["leaf", "exact", "tokens"])

    return docs.select("text").mapInArrow(run, "leaf long, exact long, tokens array<long>")


def founders(tokens: np.ndarray) -> np.ndarray:
    """For each line (a row of token hashes; rows in order of their first places) the row whose template it has."""
    m, n = tokens.shape
    need, constant = math.ceil(SIMILAR * n), math.ceil(CONSTANT * n)
    by_parts = m >= LARGE and n - DEPTH > n - need  # else every line fits the first template by its leading tokens alone
    cuts = (DEPTH + np.arange(n - need + 2) * (n - DEPTH) // (n - need + 1)).tolist() if by_parts else []
    hashes = [list_hashes(tokens[:, a:b].reshape(-1), np.arange(m) * (b - a), np.arange(1, m + 1) * (b - a)).tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    held: list[dict[int, list[int]]] = [{} for _ in hashes]  # templates by the hash of each part, as founded
    loose: list[list[int]] = [[] for _ in hashes]  # templates with a variable in it
    fixed, free, of, founded, count = np.zeros_like(tokens), np.zeros((m, n), dtype=bool), np.arange(m), np.zeros(m, np.int64), 0
    for i in range(m):
        if by_parts:
            rows = np.unique(np.array([t for part, some, h in zip(held, loose, hashes) for t in (*part.get(h[i], ()), *some)], dtype=np.int64))
        else:
            rows = np.arange(count)
        same, open_ = fixed[rows] == tokens[i], free[rows]
        agree = (same | open_).sum(1)
        fit = np.flatnonzero((agree >= need) & ((same & ~open_).sum(1) >= constant))
        if len(fit):
            best = int(rows[fit[np.argmax(agree[fit])]])
            of[i] = founded[best]
            new = ~free[best] & (fixed[best] != tokens[i])
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if new[a:b].any() and not free[best, a:b].any():
                    loose[p].append(best)
            free[best] |= new
        else:
            fixed[count], founded[count] = tokens[i], i
            for part, h in zip(held, hashes):
                part.setdefault(h[i], []).append(count)
            count += 1
    return of


def joined_lines(batch: pa.Table) -> pa.RecordBatch:
    """leaf, exact and founder (its exact) of the lines that have another's template; batch holds whole leaves, in order."""
    leaf, exact, lists = batch["leaf"].to_numpy(), batch["exact"].to_numpy(), batch["tokens"].combine_chunks()
    flat, ptr = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    begin = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
    size = np.diff(np.append(begin, len(leaf)))
    of = np.arange(len(leaf))
    two = begin[size == 2]
    if len(two):  # most leaves
        n = ptr[two + 1] - ptr[two]
        at = np.concatenate([[0], np.cumsum(n)])
        first = np.arange(at[-1]) + np.repeat(ptr[two] - at[:-1], n)
        alike = np.add.reduceat((flat[first] == flat[first + np.repeat(n, n)]).astype(np.int64), at[:-1]) >= SIMILAR * n
        of[two[alike] + 1] = two[alike]
    for a, m in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        of[a : a + m] = a + founders(flat[ptr[a] : ptr[a + m]].reshape(m, -1).view(U))
    moved = of != np.arange(len(of))
    return pa.RecordBatch.from_arrays([pa.array(leaf[moved]), pa.array(exact[moved]), pa.array(exact[of[moved]])], names=["leaf", "exact", "founder"])


def _join_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # of the last leaf
    for batch in (b for b in batches if b.num_rows):
        leaf = batch["leaf"].to_numpy()
        cut = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1 if leaf[0] != leaf[-1] else 0
        if held and (cut or held[-1]["leaf"][0].as_py() != leaf[0]):
            yield joined_lines(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield joined_lines(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield joined_lines(pa.Table.from_batches(held))


def templates(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """leaf, exact, template, first (place), last and size of each distinct line."""
    place = F.struct("id", "dedup_key", "line")
    distinct = written(lines.groupBy("leaf", "exact").agg(F.min(place).alias("first"), F.min("dedup_key").alias("low"), F.max("dedup_key").alias("high"), F.count("*").alias("size")), "lines")
    several = written(distinct.groupBy("leaf").agg(F.count("*").alias("members")).filter("members > 1"), "several", narrow=True)
    wanted = written(join_unique(distinct, several, ["leaf"], "members", distinct.count()).select("leaf", "exact", "first"), "leaves")
    tokens = token_rows(docs, wanted.select("leaf")).groupBy("leaf", "exact").agg(F.first("tokens").alias("tokens"))
    whole = wanted.join(tokens, ["leaf", "exact"]).repartition("leaf").sortWithinPartitions("leaf", "first", "exact").select("leaf", "exact", "tokens")
    joined = whole.mapInArrow(_join_leaves, "leaf long, exact long, founder long")
    return distinct.join(joined, ["leaf", "exact"], "left").withColumn("template", F.struct("leaf", F.coalesce("founder", "exact").alias("exact"))).drop("founder")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """A written table of dedup_key and the array of line numbers (from 0) that go."""
    with scratch() as needed:
        lines = written(line_rows(docs), "lines")
        found = written(templates(lines, docs), "templates")
        recurring = found.groupBy("template").agg(F.min("first").alias("place"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("members")).filter("low <> high").select("template", "place", "members")
        shared = written(recurring, "recurring")
        places = written(join_unique(found, shared, ["template"], "members", found.count()).select("leaf", "exact", "size", "place"), "places")
        hit = join_unique(lines.select("leaf", "exact", "dedup_key", "id", "line"), places, ["leaf", "exact"], "size", lines.count())
        gone = hit.filter(~((F.col("place.dedup_key") == F.col("dedup_key")) & (F.col("place.line") == F.col("line"))))
        out = written(gone.groupBy("dedup_key").agg(F.collect_set("line").alias("dedup_lines")), "gone")
        needed.append(out)
        return out


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row (a struct of the columns of docs), text without the dropped lines, and lines: the numbers of those (null if none)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, row_key(F.col(id_column), F.col(text_column)).alias("dedup_key"))
    id_, text = F.col(f"row.`{id_column}`"), F.col(f"row.`{text_column}`")
    gone = dropped_lines(keyed.select("dedup_key", id_.alias("id"), text.alias("text")))
    joined = keyed.join(gone.hint("shuffle_hash"), "dedup_key", "left").withColumn("all", F.when(F.col("dedup_lines").isNotNull(), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "dedup_lines")  # by a hash set, in one pass
    kept = F.array_join(F.transform(stay, lambda i: F.get("all", i)), "\n")
    return joined.select("row", F.when(F.col("dedup_lines").isNull(), text).otherwise(kept).alias("text"), F.col("dedup_lines").alias("lines"))


def without_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """docs with the same columns, the text without the dropped lines, and its length in length_column if there is one."""
    out = line_dedup(docs, id_column, text_column)
    new = {text_column: F.col("text")}
    if length_column in docs.columns:
        new[length_column] = F.length("text").cast(dict(docs.dtypes)[length_column])
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_lines = F.when(F.coalesce("row.text", F.lit("")) == "", 0).otherwise(F.size(F.split("row.text", "\n", -1))).cast("long")
    n_dropped = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return out.select("row.doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES: dict = {}
