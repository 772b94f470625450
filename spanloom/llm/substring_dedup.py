"""Substring deduplication with repeated-phrase automata.

A window is WINDOW consecutive words of one text. Every word under a window whose words also start anywhere else, in the same text or another, goes.

1. Anchors. The anchor of a window is its smallest-hashing run of GRAM words. Neighbouring windows with the same anchor make a segment, so
   texts give one row for about every 16 windows. Equal windows have equal anchors: a window recurs only if its anchor does. The words of
   every segment of a recurring anchor are its piece; a piece holds no other windows than its segment.
2. Confirmation. A segment that is alone with its anchor is a passage as a whole. Where several share an anchor, their windows are counted by hash;
   windows with the same set of segments make one passage: from the first of them to the last, every window of it recurs.
3. Automata. The distinct passages are dealt into shards by anchor. Each shard compiles its passages, as sequences of whole words, into one
   Aho-Corasick automaton (pyahocorasick), and the pieces of all texts are streamed through the shards that their anchors name.
4. What the automata find decides: a passage located in two places or more goes wherever it was located; one that was located once only (its
   windows were confirmed by equal hashes of different words) goes nowhere.

An anchor with many passages has them dealt over several shards, each of which meets all of its pieces; an anchor with many pieces has its passages
copied to several shards, each of which meets a part of them. A task holds the passages of one shard and streams the rest.

Defined cases: words are runs outside [\\x20\\x09-\\x0D], unchanged; a null or empty text has none; texts shorter than a window stay whole; repeated rows
repeat each other's windows; windows are judged on the input alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import dropped, row_key, scratch, written
from spanloom.llm.skew import join_unique
from spanloom.llm.words import U, Words, chunks, joined, mix, pieces_of, range_hashes, split_words, text_column

WINDOW, GRAM = 35, 4
GRAMS = WINDOW - GRAM + 1
#: Bits of a word's place beside the 40 bits of its hash; longer texts count places anew.
PLACE_BITS = 24
#: Keys of 16 bytes that may be broadcast at once: some 30 MB as a hash table; beyond it the texts are joined by a shuffle.
BROADCAST_KEYS = 250_000
#: Passages of a shard, and pieces that one copy of an anchor's passages should meet.
PASSAGES, PIECES = 4096, 25_000


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor's place, anchor, segment) of each segment; the last two are hashes."""
    key, n = words.hashes(), len(words.start)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    if n < WINDOW:
        return none
    at = np.arange(n - GRAM + 1)
    gram = range_hashes(key, at, at + GRAM, 5)
    bits, places = U(PLACE_BITS), (1 << PLACE_BITS) - 1
    high = gram >> U(24)
    low = (high << bits) | (at & places).astype(U)  # ties go to the first
    step = 1
    while step < GRAMS:  # GRAMS is a power of two
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    owner = words.owner()
    first = np.arange(n - WINDOW + 1)
    low = low[: len(first)]
    first = first[owner[first] == owner[first + WINDOW - 1]]
    if not len(first):
        return none
    anchor = first + ((low[first] & U(places)).astype(np.int64) - first & places)
    for i in np.flatnonzero(first >> PLACE_BITS != first + GRAMS - 1 >> PLACE_BITS).tolist():  # places begin anew within the window
        anchor[i] = first[i] + np.argmin(high[first[i] : first[i] + GRAMS])
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)))
    count = np.diff(np.append(new, len(first)))
    begin = first[new]
    return owner[begin], begin, count, anchor[new], gram[anchor[new]], range_hashes(key, begin, begin + count + WINDOW - 1, 9)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(texts: DataFrame) -> DataFrame:
    """key, anchor and n (its segments in the text) of each distinct anchor of each text; texts has key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, "text"):
                text, _, _, _, anchor, _ = segments(split_words(data, ptr))
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))) if len(text) else order
                n = np.diff(np.append(new, len(text))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(text[new])), _signed(anchor[new]), pa.array(n)], names=["key", "anchor", "n"])

    return texts.select("key", "text").mapInArrow(run, "key binary, anchor long, n int")


def piece_rows(asked: DataFrame) -> DataFrame:
    """key, begin (of the first word in its text), anchor, segment, lead (words before the anchor) and words of each wanted segment; asked has key, text and wanted array<long> of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, "text"):
                words = split_words(data, ptr)
                text, begin, count, place, anchor, segment = segments(words)
                lists = rows.column("wanted")
                row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
                hit = np.flatnonzero(np.isin(mix(anchor) + text.astype(U), mix(lists.flatten().to_numpy().view(U)) + row.astype(U)))
                text, begin, place = text[hit], begin[hit], place[hit]
                last = begin + count[hit] + WINDOW - 2
                found = pieces_of(data, words.start[begin], words.end[last])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key").take(pa.array(text)), pa.array(begin - words.ptr[text]), _signed(anchor[hit]), _signed(segment[hit]), pa.array((place - begin).astype(np.int32)), found],
                    names=["key", "begin", "anchor", "segment", "lead", "words"],
                )

    return asked.select("key", "text", "wanted").mapInArrow(run, "key binary, begin long, anchor long, segment long, lead int, words binary")


def window_rows(rows: DataFrame, bits: int = 64) -> DataFrame:
    """segment, times, window (hash of bits bits) and lead (words before the anchor) of each window; rows has segment, anchor, times, lead and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ptr in chunks(batch, "words"):
                words = split_words(data, ptr)
                count = np.diff(words.ptr) - WINDOW + 1
                row, at = np.repeat(np.arange(part.num_rows), count), _within(count)
                start = words.ptr[row] + at
                column = lambda name: part.column(name).to_numpy()[row]
                lead = (column("lead") - at).astype(np.int32)
                window = range_hashes(words.hashes(), start, start + WINDOW, 9) >> U(64 - bits) if bits else np.zeros(len(row), U)
                place = mix(column("anchor").view(U) ^ mix(lead.astype(U) + U(1)))  # equal windows have equal anchors at equal places
                yield pa.RecordBatch.from_arrays([pa.array(column("segment")), pa.array(column("times")), _signed(mix(window) ^ place), pa.array(lead)], names=["segment", "times", "window", "lead"])

    return rows.select("segment", "anchor", "times", "lead", "words").mapInArrow(run, "segment long, times long, window long, lead int")


def passages(pieces: DataFrame, bits: int = 64) -> DataFrame:
    """anchor, passage (number) and words of the distinct passages that recur, as far as hashes can tell."""
    each = written(pieces.groupBy("anchor", "segment", "words").agg(F.min("lead").alias("lead"), F.count("*").alias("times")), "segments")  # by their words: no two different ones are taken for one
    shared = each.groupBy("anchor").agg(F.count("*").alias("members"))
    total = each.count()
    known = join_unique(each, written(shared.filter("members > 1"), "shared"), ["anchor"], "members", total)
    windows = window_rows(known, bits).groupBy("window").agg(F.sum("times").alias("times"), F.bit_xor("segment").alias("set"), F.min("segment").alias("segment"), F.first("lead").alias("lead"))
    # One passage for each set of segments, told by their number, the exclusive or of their hashes and the smallest of them.
    classes = windows.filter("times > 1").groupBy("segment", "set", "times").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    cut = written(classes.select("segment", "low", "high").distinct(), "cuts")
    mixed = cut_words(cut.join(each.select("segment", "anchor", "lead", "words"), "segment"))
    alone = each.join(shared.filter("members = 1").select("anchor"), "anchor").filter("times > 1").select("anchor", "words")
    out = written(alone.unionByName(mixed).select("anchor", F.monotonically_increasing_id().alias("passage"), "words"), "passages")
    dropped(each, cut)
    return out


def cut_words(rows: DataFrame) -> DataFrame:
    """anchor and the words from high before the anchor to the end of the window that starts low before it; rows has anchor, lead, low, high and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ptr in chunks(batch, "words"):
                words = split_words(data, ptr)
                lead, low, high = (part.column(c).to_numpy() for c in ("lead", "low", "high"))
                start, stop = words.ptr[:-1] + lead - high, words.ptr[:-1] + lead - low + WINDOW - 1
                yield pa.RecordBatch.from_arrays([part.column("anchor"), pieces_of(data, words.start[start], words.end[stop])], names=["anchor", "words"])

    return rows.select("anchor", "lead", "low", "high", "words").mapInArrow(run, "anchor long, words binary")


class Shard:
    """The automaton of some passages, over the codes of their words."""

    def __init__(self, numbers: np.ndarray, column: pa.Array):
        words = split_words(*text_column(column))
        coded = pieces_of(words.data, words.start, words.end).dictionary_encode()
        self.vocabulary, codes = coded.dictionary, coded.indices.to_numpy().tolist()
        self.numbers, self.size = numbers, np.diff(words.ptr)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (a, b) in enumerate(zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True)):
            self.automaton.add_word(tuple(codes[a:b]), i)
        self.automaton.make_automaton()

    def located(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, passage, first word, end) of every occurrence in the pieces."""
        words = split_words(*text_column(column))
        codes = pc.index_in(pieces_of(words.data, words.start, words.end), value_set=self.vocabulary).fill_null(len(self.vocabulary)).to_numpy().tolist()
        found, bounds, scan = [], words.ptr.tolist(), self.automaton.iter
        for i in range(len(bounds) - 1):
            found += [(i, which, end) for end, which in scan(tuple(codes[bounds[i] : bounds[i + 1]]))]
        piece, which, end = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return piece, self.numbers[which], end + 1 - self.size[which], end + 1


def locate(passages_: DataFrame, pieces: DataFrame) -> DataFrame:
    """key, passage, start and stop (words of the text) of every occurrence of a passage."""
    weight = pieces.groupBy("anchor").agg(F.count("*").alias("pieces"))
    held = passages_.groupBy("anchor").agg(F.count("*").alias("passages"))
    plan = held.join(weight, "anchor").select("anchor", "pieces", "passages", F.ceil(F.col("passages") / PASSAGES).cast("int").alias("parts"), F.ceil(F.col("pieces") / PIECES).cast("int").alias("copies"))
    plan = written(plan, "plan", narrow=True)
    size = plan.agg(F.sum(F.col("passages") * F.col("copies")).alias("p"), F.sum("pieces").alias("q"), F.sum("passages").alias("own")).first()
    shards = max(1, -(-(size["p"] or 0) // PASSAGES), -(-(size["q"] or 0) // PIECES))
    unit = F.pmod(F.xxhash64("anchor", "part", "copy"), F.lit(shards)).alias("unit")
    total = max(1, size["q"] or 0)
    dealt = lambda n, by: F.pmod(F.hash(*by), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    own = join_unique(passages_, plan, ["anchor"], "passages", size["own"] or 0).withColumn("part", dealt("parts", ["passage"])).withColumn("copy", every("copies"))
    own = own.select(unit, F.lit(0).alias("kind"), "passage", none.cast("binary").alias("key"), none.cast("long").alias("begin"), "words")
    met = join_unique(pieces, plan, ["anchor"], "pieces", total).withColumn("copy", dealt("copies", ["key", "begin"])).withColumn("part", every("parts"))
    met = met.select(unit, F.lit(1).alias("kind"), none.cast("long").alias("passage"), "key", "begin", "words")
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, shard = [], None, None
        for batch in batches:
            units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(units)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if units[a] != unit:
                    held, unit, shard = [], units[a], None
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if shard is None and not held:
                    continue  # no passage of the anchor fell into this part
                if shard is None:
                    whole = pa.Table.from_batches(held)
                    shard, held = Shard(whole["passage"].to_numpy(), whole["words"].combine_chunks()), []
                piece, passage, start, stop = shard.located(part.column("words"))
                begin = part.column("begin").to_numpy()[piece]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(piece)), pa.array(passage), pa.array(begin + start), pa.array(begin + stop)], names=["key", "passage", "start", "stop"])

    both = own.unionByName(met).repartition(tasks, "unit").sortWithinPartitions("unit", "kind")
    return both.mapInArrow(run, "key binary, passage long, start long, stop long")


def _small(keys: DataFrame) -> bool:
    return keys.count() <= BROADCAST_KEYS


def cleaned(texts: DataFrame) -> DataFrame:
    """id, n_words, n_removed and text (the kept words) of texts; texts has id, text and gone array<struct<start, stop>> of words that go (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, "text"):
                words = split_words(data, ptr)
                inside = np.zeros(len(words.start) + 1, dtype=np.int64)
                lists = rows.column("gone")
                spans = lists.flatten()
                base = words.ptr[:-1][np.repeat(np.arange(rows.num_rows), lists.value_lengths().fill_null(0).to_numpy())]
                np.add.at(inside, base + spans.field("start").to_numpy(), 1)
                np.add.at(inside, base + spans.field("stop").to_numpy(), -1)
                gone = np.cumsum(inside[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.ptr[1:]] - total[words.ptr[:-1]]
                kept, bounds = joined(words, ~gone)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(words.ptr)), pa.array(removed), pieces_of(kept, bounds[:-1], bounds[1:]).cast(pa.string())], names=["id", "n_words", "n_removed", "text"])

    return texts.select("id", "text", "gone").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, n_words long, n_removed long, text string")


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: id, n_words, n_removed and text (the kept words joined by one space). bits: of the hashes that confirm windows, for tests."""
    texts = docs.select(row_key(F.col(id_column), F.col(text_column)).alias("key"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    with scratch() as needed:
        rows = written(anchor_rows(texts), "rows")
        total = rows.count()
        recurring = written(rows.groupBy("anchor").agg(F.sum("n").alias("times"), F.count("*").alias("size")).filter("times > 1"), "anchors")
        again = join_unique(rows.select("key", "anchor"), recurring.select("anchor", "size"), ["anchor"], "size", total)
        wanted = written(again.groupBy("key").agg(F.collect_set("anchor").alias("wanted")), "wanted")
        some = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi") if _small(wanted) else texts
        pieces = written(piece_rows(some.join(wanted.hint("shuffle_hash"), "key")), "pieces")
        dropped(rows, recurring, wanted)
        confirmed = passages(pieces, bits)
        hits = written(locate(confirmed, pieces), "hits")
        dropped(pieces, confirmed)
        once = written(hits.groupBy("passage").agg(F.count("*").alias("places")).filter("places = 1").select("passage"), "once", narrow=True)
        if once.limit(1).count():
            hits = hits.join(once, "passage", "left_anti")
        gone = written(hits.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("gone")), "gone")
        needed.append(gone)
    if _small(gone):
        few = F.broadcast(gone.select("key"))
        rest = texts.join(few, "key", "left_anti").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
        hit = texts.join(few, "key", "left_semi").join(gone.hint("shuffle_hash"), "key")
        found = cleaned(hit).unionByName(cleaned(rest))
    else:
        found = cleaned(texts.join(gone.hint("shuffle_hash"), "key", "left"))
    return found.withColumnRenamed("id", id_column)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict = {}
