"""Cutting texts into tokens and lines with character offsets, within the row, over Arrow batches.

Offsets are running sums over the pieces of one text. Spark's own functions get them only by a window over exploded pieces, which shuffles
whole texts by key, or by a fold that copies its array for every piece. Here each batch is cut with array operations over its code points, so
a record stays where it was read and costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

OTHER, WORD, SPACE = 0, 1, 2
#: Bytes of text that are cut at once; a longer text is cut alone.
SLICE = 2 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: Python's \\w, Python's \\s, or another."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(len(out)):
        s = chr(c)
        if s.isalnum() or s == "_":
            out[c] = WORD
        elif s.isspace():
            out[c] = SPACE
    return out


class Texts:
    """The code points of some texts: those of text i are [ptr[i], ptr[i + 1])."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        self.data = (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        self.points = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        self.at = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))  # where each code point begins
        self.ptr = np.searchsorted(self.at, offsets - offsets[0])

    def owner(self, points: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ptr, points, side="right") - 1

    def strings(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The texts of ranges of code points."""
        first, size = self.at[start], self.at[end] - self.at[start]
        bounds = np.concatenate([[0], np.cumsum(size)])
        taken = self.data[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], size)]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.string())


def token_bounds(texts: Texts, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens: runs of word characters and other single characters that are not white space, cut at edges too."""
    kind = classes()[texts.points]
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.ones(n, dtype=bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == OTHER)
    begin[texts.ptr[texts.ptr < n]] = True
    if edges is not None:
        begin[edges[edges < n]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    keep = kind[start] != SPACE
    return start[keep], end[keep]


def line_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines; a text without characters has one."""
    breaks = np.flatnonzero(texts.points == 0x0A)
    start = np.sort(np.concatenate([texts.ptr[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, texts.ptr[1:]]), kind="stable")
    return start, end


#: Members of lists that are handled at once.
MEMBERS = 1 << 18


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take SLICE bytes, or whose lists hold MEMBERS; or one longer text or list."""
    values = batch.column(column)
    lists = pa.types.is_list(values.type)
    size = (values.value_lengths() if lists else pc.binary_length(values)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, row, limit = np.cumsum(size, dtype=np.int64), 0, MEMBERS if lists else SLICE
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def _nested(owner: np.ndarray, n: int, **fields: pa.Array) -> pa.Array:
    items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), items)


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list, and the row of each member of a list column."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, np.repeat(np.arange(len(size)), size)


def _field(lists: pa.Array, name: str) -> np.ndarray:
    """A field of whole numbers of the members of a column of lists of structs; null counts as -1."""
    return pc.fill_null(lists.flatten().field(name), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _fields_with(lists: pa.Array, **fields: pa.Array) -> pa.Array:
    """A column of lists of structs with more fields in each struct; null lists stay null."""
    items, size = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    old = {f.name: items.field(i) for i, f in enumerate(items.type) if f.name not in fields}
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([*old.values(), *fields.values()], names=[*old, *fields]), mask=lists.is_null() if lists.null_count else None)


def _int(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


#: What alignment adds to a span.
ALIGNED = {"first": "int", "last": "int", "n_tokens": "int", "aligned": "boolean"}


def _align(spans: pa.Array, row: np.ndarray, low: np.ndarray, high: np.ndarray, token_row: np.ndarray, token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """spans with first, last, n_tokens and aligned. Tokens stand in order and apart, so those inside a span are found by two sorted searches.

    low and high are the span's edges among token_start and token_end, where rows follow each other; start and end are its own.
    """
    first, last = np.searchsorted(token_start, low, side="left"), np.searchsorted(token_end, high, side="right") - 1
    n = np.maximum(last - first + 1, 0)
    some = n > 0
    base = np.searchsorted(token_row, row)
    fit = np.zeros(len(row), dtype=bool)
    fit[some] = (token_start[first[some]] == low[some]) & (token_end[last[some]] == high[some]) & start[some] & end[some]
    return _fields_with(spans, first=pa.array((first - base).astype(np.int32), mask=~some), last=pa.array((last - base).astype(np.int32), mask=~some), n_tokens=_int(n), aligned=pa.array(fit))


def _schema(records: DataFrame, **changed: str | DataType) -> StructType:
    """The columns of records, some of them new, by name or by their DDL."""
    kinds = {f.name: f.dataType for f in records.schema} | {name: DataType.fromDDL(kind) if isinstance(kind, str) else kind for name, kind in changed.items()}
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def _aligned_type(records: DataFrame, spans: str) -> ArrayType:
    old = [f for f in records.schema[spans].dataType.elementType if f.name not in ALIGNED]
    return ArrayType(StructType([*old, *(StructField(name, DataType.fromDDL(kind)) for name, kind in ALIGNED.items())]))


def _replaced(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The columns of part, some of them new, in the order of _schema()."""
    whole = dict(zip(part.schema.names, part.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(whole.values()), names=list(whole))


TOKEN = "struct<pos:int,start:int,end:int,next_end:int"


def with_tokens(records: DataFrame, text: str = "text", edges: str | None = None, words: bool = True, spans: str | None = None, then: tuple[Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """records with tokens: array<struct<pos, start, end, next_end (of the next token, or null), token>>, cut at the edges of an array<int> column too.

    spans: an array<struct<start, end, ...>> at whose edges tokens are cut as well. Its structs come out with first and last (positions of the tokens inside), n_tokens and
    aligned (whether those tokens begin and end where the span does). All in the pass that cuts the text.
    words: whether tokens hold their texts. A null text has no tokens.
    then: what is made of each slice of these rows in the same pass (batches, some or none), and the columns that come out.
    """
    kind = f"array<{TOKEN}" + (",token:string>>" if words else ">>")
    schema = _schema(records, **({spans: _aligned_type(records, spans)} if spans else {}), tokens=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                texts = Texts(part.column(text))
                inside = lambda row, at: np.clip(texts.ptr[row] + at, texts.ptr[row], texts.ptr[row + 1])  # noqa: B023, E731
                cuts = []
                if edges is not None:
                    cuts.append(inside(_rows_of(part.column(edges))[1], part.column(edges).flatten().to_numpy()))
                if spans is not None:
                    row = _rows_of(part.column(spans))[1]
                    own = [_field(part.column(spans), name) for name in ("start", "end")]
                    low, high = (inside(row, at) for at in own)
                    cuts += [low, high]
                start, end = token_bounds(texts, np.concatenate(cuts) if cuts else None)
                # Tokens stand in order, so those of a text begin where its first code point would go among them.
                opens = np.searchsorted(start, texts.ptr)
                owner = np.repeat(np.arange(part.num_rows), np.diff(opens))
                base = texts.ptr[owner]
                same = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
                following = np.append(end[1:], 0) - base if len(end) else end
                fields = {"pos": _int(np.arange(len(owner)) - opens[owner]), "start": _int(start - base), "end": _int(end - base), "next_end": pa.array(following.astype(np.int32), mask=~same)}
                if words:
                    fields["token"] = texts.strings(start, end)
                new = {"tokens": _nested(owner, part.num_rows, **fields)}
                if spans is not None:
                    new[spans] = _align(part.column(spans), row, low, high, owner, start, end, *(texts.ptr[row] + at == x for at, x in zip(own, (low, high), strict=True)))
                out = _replaced(part, **new)
                if then:
                    yield from then[0](out)
                else:
                    yield out

    return records.mapInArrow(run, then[1] if then else schema)


def _places(part: pa.RecordBatch, tokens: str, spans: str) -> tuple[np.ndarray, ...]:
    """Row, start and end of tokens and of spans, with rows apart by more than any offset."""
    out = []
    for name in (tokens, spans):
        lists = part.column(name)
        row = _rows_of(lists)[1]
        start, end = (np.clip(_field(lists, f), -1, (1 << 31) - 1) for f in ("start", "end"))
        out += [row, (row << 32) + start, (row << 32) + end]
    return tuple(out)


def with_alignment(records: DataFrame, tokens: str = "tokens", spans: str = "spans") -> DataFrame:
    """records whose spans have first, last, n_tokens and aligned, by tokens that stand in order in the row already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, tokens):
                owner, start, end, row, low, high = _places(part, tokens, spans)
                yes = np.ones(len(row), bool)
                yield _replaced(part, **{spans: _align(part.column(spans), row, low, high, owner, start, end, yes, yes)})

    return records.mapInArrow(run, _schema(records, **{spans: _aligned_type(records, spans)}))


def _labels(part: pa.RecordBatch, tokens: str, spans: str, names: pa.Array, ids: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, label) of the distinct B and I labels of the tokens among the first max_length of a row, in order.

    A token inside a span begins it (B) if it starts where the span starts, and else continues it (I); empty tokens and labels that are not known have none.
    """
    owner, start, end, row, low, high = _places(part, tokens, spans)
    known = pc.index_in(part.column(spans).flatten().field("label"), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
    base = np.searchsorted(owner, np.arange(part.num_rows + 1))
    first = np.searchsorted(start, low, side="left")
    stop = np.minimum(np.searchsorted(end, high, side="right"), np.minimum(base[row + 1], base[row] + max_length))
    n = np.where(known >= 0, np.maximum(stop - first, 0), 0)
    at = np.repeat(np.arange(len(row)), n)
    token = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    label = 2 * ids[known[at]] + np.where(start[token] > low[at], 2, 1)
    real = end[token] > start[token]
    found = np.unique(np.stack([token[real], label[real]], axis=1), axis=0) if real.any() else np.zeros((0, 2), np.int64)
    return owner[found[:, 0]], found[:, 0] - base[owner[found[:, 0]]], found[:, 1]


def with_labels(records: DataFrame, labels: dict[str, int], max_length: int, tokens: str = "tokens", spans: str = "spans") -> DataFrame:
    """records with bio: array<struct<pos, label_id>>, the B and I labels of each of the first max_length tokens, from spans (start, end, label). labels: the inventory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = pa.array(list(labels), pa.string()), np.array(list(labels.values()), dtype=np.int64)
        for batch in batches:
            for part in _slices(batch, tokens):
                row, pos, label = _labels(part, tokens, spans, names, ids, max_length)
                yield _replaced(part, bio=_nested(row, part.num_rows, pos=_int(pos), label_id=_int(label)))

    return records.mapInArrow(run, _schema(records, bio="array<struct<pos:int,label_id:int>>"))


def with_label_bits(records: DataFrame, labels: dict[str, int], lengths: Sequence[int], tokens: str = "tokens", spans: str = "spans") -> DataFrame:
    """records with padded_to, loss_mask and label_bits: the training target of a record in one row.

    lengths: the lengths that records are padded to, in ascending order; a record takes the first that holds its tokens, or the last, which cuts it. loss_mask has a 1 for each
    token that is not empty, then zeros. label_bits has for each position as many longs as the ids of all labels need, 64 a long: bit i % 64 of long i // 64
    is set if the token has the label i of with_labels(). A record without tokens has padded_to 0 and empty lists.
    """
    words, steps = (2 * max(labels.values(), default=0) + 2) // 64 + 1, np.array(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = pa.array(list(labels), pa.string()), np.array(list(labels.values()), dtype=np.int64)
        for batch in batches:
            for part in _slices(batch, tokens):
                size, owner = _rows_of(part.column(tokens))
                padded = np.where(size > 0, steps[np.minimum(np.searchsorted(steps, size), len(steps) - 1)], 0)
                begin = np.concatenate([[0], np.cumsum(padded)])
                place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                kept = (place < padded[owner]) & (_field(part.column(tokens), "end") > _field(part.column(tokens), "start"))
                mask = np.zeros(begin[-1], dtype=np.int8)
                mask[begin[owner[kept]] + place[kept]] = 1
                row, pos, label = _labels(part, tokens, spans, names, ids, int(steps[-1]))
                bits = np.zeros(begin[-1] * words, dtype=np.uint64)
                np.bitwise_or.at(bits, (begin[row] + pos) * words + label // 64, np.uint64(1) << (label % 64).astype(np.uint64))
                lists = lambda values, wide=1: pa.ListArray.from_arrays(pa.array((begin * wide).astype(np.int32)), pa.array(values))  # noqa: B023, E731
                yield _replaced(part, padded_to=_int(padded), loss_mask=lists(mask), label_bits=lists(bits.view(np.int64), words))

    return records.mapInArrow(run, _schema(records, padded_to="int", loss_mask="array<tinyint>", label_bits="array<bigint>"))


def with_pieces(records: DataFrame, encode: Callable[[Sequence[str]], Sequence[Sequence[tuple[int, int]]]], text: str = "text") -> DataFrame:
    """records with tokens by a tokenizer of the caller: encode gives the character offsets of the pieces of each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                texts = Texts(part.column(text))
                found = encode(part.column(text).fill_null("").to_pylist())
                size = np.array([len(x) for x in found], dtype=np.int64)
                pairs = [np.asarray(x, dtype=np.int64).reshape(-1, 2) for x in found]
                flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
                owner = np.repeat(np.arange(part.num_rows), size)
                pos = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
                fields = {"pos": _int(pos), "start": _int(flat[:, 0]), "end": _int(flat[:, 1]), "next_end": pa.array(np.append(flat[1:, 1], 0).astype(np.int32)[: len(flat)], mask=last)}
                fields["token"] = texts.strings(texts.ptr[owner] + flat[:, 0], texts.ptr[owner] + flat[:, 1])
                yield _replaced(part, tokens=_nested(owner, part.num_rows, **fields))

    return records.mapInArrow(run, _schema(records, tokens=f"array<{TOKEN},token:string>>"))


def with_lines(records: DataFrame, text: str = "text", words: bool = True) -> DataFrame:
    """records with lines: array<struct<line (from 0), start, end, text>>. A null text has none, an empty one has one. words: whether with the texts of lines."""
    schema = _schema(records, lines="array<struct<line:int,start:int,end:int" + (",text:string>>" if words else ">>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                texts = Texts(part.column(text))
                start, end = line_bounds(texts)
                count = 1 + np.diff(np.searchsorted(np.flatnonzero(texts.points == 0x0A), texts.ptr))
                owner = np.repeat(np.arange(part.num_rows), count)
                there = part.column(text).is_valid().to_numpy(zero_copy_only=False)[owner]
                start, end, owner = start[there], end[there], owner[there]
                fields = {"line": _int(np.arange(len(owner)) - np.searchsorted(owner, owner)), "start": _int(start - texts.ptr[owner]), "end": _int(end - texts.ptr[owner])}
                if words:
                    fields["text"] = texts.strings(start, end)
                yield _replaced(part, lines=_nested(owner, part.num_rows, **fields))

    return records.mapInArrow(run, schema)


def exploded(records: DataFrame, keys: list[str], array: str) -> DataFrame:
    """keys and the fields of each element of an array of structs."""
    return records.select(*keys, F.inline(array))
