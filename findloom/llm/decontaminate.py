"""Benchmark decontamination: texts of a test set found in documents, and removed.

Both sides are normalised to words (A-Z in lower case; letters, digits and all
beyond ASCII). Every window of consecutive item words (a short item is one
window) has a hash in a set that is broadcast; each task rolls the same hash
over the words of its documents, looks all windows up at once in numpy, and
compares the words of each hit with the item's, so a hash collision cannot make
one. Documents are not shuffled.

What is broadcast is bounded by ``BLOCK_BYTES`` of item text. A larger test set
is cut into pieces that overlap by a window less one word, the pieces are dealt
into blocks, and the documents are scanned once a block; the spans found are then
put together by row.

Defined results: a null or empty text, of a document or an item, has no words
and hits nothing; an item counts once in a document however often its windows
are found, and items with equal ids are one; a null item id marks words but is
neither counted nor listed; repeated documents and ids are judged row by row;
other columns are not read by ``find_windows``, and pass through ``remove``
whatever their names; empty tables give empty results or nothing hit. A text is
split into words in pieces, so memory follows eight bytes a word of the longest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stored

WINDOW = 10
BLOCK_BYTES = 16 << 20
PIECE_WORDS = 4096  # of an item
PIECE_BYTES = 4 << 20  # of a document's text
_ROLL = np.uint64(0x9E3779B97F4A7C15)
# Bytes as words have them: A-Z in lower case, what is no part of a word as a blank.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SPANS, _ITEMS = T.ArrayType(_SPAN), T.ArrayType(T.StringType())


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """One hash a row of word numbers; for a text the columns are the text itself, each one word further."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        mixed = (column.astype(np.uint64) + np.uint64(1)) * _ROLL
        out = out * _ROLL + (mixed ^ (mixed >> np.uint64(29)))
    return out


def _further(codes: np.ndarray, length: int) -> list[np.ndarray]:
    n = len(codes) - length + 1
    return [codes[i : i + n] for i in range(length)]


class Windows:
    """The windows of a block of items: sorted hashes, where their words begin, and the items that have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: i for i, name in enumerate(self.names)}
        coded = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in data.split()], dtype=np.int32) for _, data in items]
        sizes = np.array([len(codes) for codes in coded], dtype=np.int64)
        self.flat = np.concatenate([*coded, np.zeros(window, dtype=np.int32)])
        begins = np.cumsum(sizes) - sizes
        owners = np.array([place.get(name, -1) for name, _ in items], dtype=np.int32)
        self.by_length = {}
        for length in np.unique(np.minimum(sizes, window)).tolist():
            of = np.flatnonzero(np.minimum(sizes, window) == length)
            counts = sizes[of] - length + 1
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            self.by_length[length] = self._grouped(length, np.repeat(begins[of], counts) + inside, np.repeat(owners[of], counts))

    def _same(self, one: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
        """Whether the words from two places on are the same."""
        same = np.ones(len(one), dtype=bool)
        for i in range(length):
            same &= self.flat[one + i] == self.flat[other + i]
        return same

    def _grouped(self, length: int, start: np.ndarray, owner: np.ndarray) -> tuple:
        """``(hashes, starts, first, owners)``: the items of window i are ``owners[first[i]:first[i + 1]]``."""
        hashes = _hashes([self.flat[start + i] for i in range(length)])
        order = np.lexsort((owner, hashes))
        hashes, start, owner = hashes[order], start[order], owner[order]
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & self._same(start[1:], start[:-1], length)])
        group = np.cumsum(~again) - 1
        once = ~again | np.concatenate([[True], owner[1:] != owner[:-1]])
        first = np.concatenate([[0], np.cumsum(np.bincount(group[once]))])
        return hashes[~again], start[~again], first, owner[once]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """``(spans, items)`` of a text's word numbers: starts and ends of all windows found in it, and whose they are."""
        spans, items = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for length, (hashes, starts, first, owners) in self.by_length.items():
            if np.count_nonzero(codes) < length:
                continue
            rolled = _hashes(_further(codes, length))
            row = np.searchsorted(hashes, rolled)
            row[row == len(hashes)] = 0
            at = np.flatnonzero(hashes[row] == rolled)
            row = row[at]
            while len(at):  # windows may share a hash: one after the other is compared
                same = np.ones(len(at), dtype=bool)
                for i in range(length):
                    same &= codes[at + i] == self.flat[starts[row] + i]
                spans.append(np.stack([at[same], at[same] + length], axis=1))
                items.extend(owners[first[r] : first[r + 1]] for r in np.unique(row[same]))
                row = row + 1
                more = row < len(hashes)
                more[more] = hashes[row[more]] == rolled[at[more]]
                at, row = at[more], row[more]
        return np.concatenate(spans), [self.names[i] for i in np.unique(np.concatenate(items)) if i >= 0]


def _pieces(plain: bytes) -> Iterator[bytes]:
    """Text as words, cut at blanks."""
    at = 0
    while at < len(plain):
        end = at + PIECE_BYTES
        end = plain.find(b" ", end) if end < len(plain) else -1
        yield plain[at : end if end >= 0 else len(plain)]
        at = end if end >= 0 else len(plain)


def _coded(text: str | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The numbers of a text's words; 0 for words that no item has."""
    known = numbers.get
    parts = [np.array([known(w, 0) for w in piece.split()], dtype=np.int32) for piece in _pieces(_utf8(text).translate(_AS_WORDS))]
    return np.concatenate([np.zeros(0, dtype=np.int32), *parts])


def _joined(spans: np.ndarray) -> list[dict]:
    """Spans in order without overlaps; those that touch are one."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return [{"start": a, "end": b} for a, b in zip(spans[new, 0].tolist(), reach[last].tolist(), strict=True)]


def _without(text: str, spans: list[dict]) -> str:
    """``text`` without the words in ``spans`` and what stands between them."""
    raw = _utf8(text)
    blank = np.frombuffer(raw.translate(_AS_WORDS), dtype=np.uint8) == 32
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : start[span["start"]]])
        at = end[span["end"] - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Windows]:
    """The windows of the items in blocks of bounded size; at least one block, which may be empty."""

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _utf8(text).translate(_AS_WORDS).split()
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WORDS):
                    ids.append(name)
                    texts.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["item", "words"])

    picked = benchmark.select(_named(id_col).cast("string").alias("item"), _named(text_col).alias("text"))
    pieces = stored(picked.mapInArrow(cut, "item string, words binary").distinct(), "items")
    size = pieces.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for i in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i).toArrow()
        yield Windows(list(zip(rows["item"].to_pylist(), rows["words"].to_pylist(), strict=True)), window)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _free(taken: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has."""
    lower = {name.lower() for name in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        out.append(name)
    return out


def _scanned(docs: DataFrame, windows: Windows, text_col: str, keep: list[str], new: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, named by ``new``, the number of words, the spans of words hit and the items."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    names = [*keep, *new]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    order = list(dict.fromkeys([*keep, text_col]))
    at = order.index(text_col)

    def run(batches):
        known = shared.value
        for batch in batches:
            sizes, spans, items = [], [], []
            for i in range(batch.num_rows):
                codes = _coded(batch.column(at)[i].as_py(), known.numbers)
                found, owners = known.find(codes)
                sizes.append(len(codes))
                spans.append(_joined(found))
                items.append(owners)
            more = [pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], names)

    kinds = [T.LongType(), _SPANS, _ITEMS]
    fields = [*(docs.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]
    return docs.select(*map(_named, order)).mapInArrow(run, T.StructType(fields))


def _unioned(spans: Column) -> Column:
    """Spans of several blocks in order, those that overlap or touch put together."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, keep: list[str], new: list[str], item_cols: tuple[str, str], window: int) -> DataFrame:
    """``_scanned`` over all blocks of the test set."""
    blocks = _blocks(benchmark, *item_cols, window)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        return _scanned(docs, first, text_col, keep, new)
    (row,) = _free([*docs.columns, *new], "row")
    _, spans, items = new
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    once = stored(_scanned(rows, first, text_col, [row, *keep], new), "block")
    hits = once.select(row, spans, items)
    while more is not None:
        hits = hits.union(stored(_scanned(rows, more, text_col, [row], new).select(row, spans, items), "block"))
        more = next(blocks, None)
    hits = hits.where(F.size(spans) > 0).groupBy(row).agg(
        F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(items))).alias(items)
    )
    joined = once.drop(spans, items).join(hits, row, "left")
    whole = _unioned(F.coalesce(F.col(spans), F.array().cast(_SPANS)))
    return joined.withColumns({spans: whole, items: F.coalesce(F.col(items), F.array().cast(_ITEMS))}).select(*map(_named, [*keep, *new]))


def _hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def find_windows(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_cols: tuple[str, str] = ("item_id", "text"),
    window: int = WINDOW,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)``: the words of each document that lie in windows of items, as spans of
    words without their ends, and these items' ids as strings, in order."""
    picked = docs.select(_named(id_col).alias("doc_id"), _named(text_col).alias("text"))
    found = _marked(picked, benchmark, "text", ["doc_id"], ["n_words", "spans", "items"], item_cols, window)
    return found.select("doc_id", "n_words", _hit("spans").alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def remove(
    docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, text_col: str = "text", item_cols: tuple[str, str] = ("item_id", "text"),
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` without what is of the test set: a document of whose words more than ``max_share`` are hit goes, others
    lose the spans hit. Texts without hits, null ones too, stay as they are."""
    new = _free(docs.columns, "n_words", "spans", "items")
    found = _marked(docs, benchmark, text_col, docs.columns, new, item_cols, window)
    kept = found.where(_hit(new[1]) <= F.lit(max_share) * F.col(new[0]))
    at, n = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            columns, spans = batch.columns[:n], batch.column(n + 1)
            hit = np.flatnonzero(np.asarray(pc.list_value_length(spans)) > 0)
            if len(hit):
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i] = _without(texts[i], spans[int(i)].as_py())
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:n])

    return kept.mapInArrow(run, docs.schema)
