"""Vectors as short codes: product quantisation by Lloyd's rounds with Elkan's bounds, all in integers.

A vector is cut into equal parts, and each part has a codebook of its own. A
row keeps, from round to round, an upper bound of each part's distance to its
entry and one lower bound per entry. When entries move, the bounds move by as
much. An entry whose lower bound, or half of whose distance to the present
entry, is above the upper bound cannot be nearer and is left out; all others are
compared by exact integer squared distances, equal ones going to the lower
index. Bounds are rounded away from what they bound, so they only save work.

A round's rows are a table in the shared folder. Tasks add up their own rows by
part and entry; a codebook (entries times dimensions) is all that the driver
sees. Lower bounds are stored as bytes, in steps of the largest of a row's part.

Defined results: rows whose vector is null or has null or non-finite components
go; the first row by id (null ids last), then by components, whose vector can be
cut evenly sets the dimension, and rows of any other length have neither code
nor error and move no entry; equal rows count as often as they are there; with
fewer rows than entries the codebooks are as short; an empty table gives an
empty result; other columns are not read. Components are floored after scaling;
those beyond ``_largest`` raise an error, since their squared distances would not
fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .skew import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_ROWS = 4096  # of a batch that are compared at once
_STATE = "assigned binary, upper binary, step binary, lower binary"


def _largest(width: int) -> int:
    """The largest component whose squared distances over a part of ``width`` fit into 64 bits."""
    return math.isqrt((1 << 62) // (4 * max(width, 1)))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, right but for a few last places either way."""
    return np.sqrt(squares.astype(np.float64))


_ULPS = 1e-15  # more than rounding moves a root of an integer


class Bounds:
    """What a batch knows of its rows: entry, upper bound, and a lower bound for each entry, by part."""

    def __init__(self, rows: int, parts: int, entries: int):
        self.assigned = np.zeros((rows, parts), dtype=np.uint8 if entries <= 256 else np.uint32)
        self.upper = np.full((rows, parts), np.inf)
        self.lower = np.zeros((rows, parts, entries))

    def stored(self) -> list[list[bytes]]:
        """Upper bounds as 32-bit floats rounded up, lower ones as bytes rounded down."""
        upper = np.nextafter(self.upper.astype(np.float32), np.float32(np.inf))
        step = np.nextafter((self.lower.max(axis=2) / 255).astype(np.float32), np.float32(np.inf))
        # A step up to infinity, or of nothing at all, still gives bounds that hold.
        quotient = np.floor(self.lower / np.maximum(step, np.float32(1e-30))[:, :, None].astype(np.float64))
        count = np.clip(quotient, 0, 255).astype(np.uint8)
        over = count * step[:, :, None].astype(np.float64) > self.lower
        count[over & (count > 0)] -= 1
        return [[row.tobytes() for row in x] for x in (self.assigned, upper, step, count)]

    def load(self, columns: list[pa.Array], moved: np.ndarray) -> None:
        """Bounds of the round before, shifted by how far each entry of each part moved."""
        n, parts, entries = self.lower.shape
        read = lambda i, kind, *shape: np.frombuffer(b"".join(columns[i].to_pylist()), dtype=kind).reshape(n, *shape)
        self.assigned = read(0, self.assigned.dtype, parts).copy()
        step = read(2, np.float32, parts).astype(np.float64)
        self.lower = _down(_down(read(3, np.uint8, parts, entries) * step[:, :, None]) - moved[None])
        self.upper = _up(read(1, np.float32, parts).astype(np.float64) + np.take_along_axis(moved.T, self.assigned.astype(np.int64), axis=0))


def _assign_part(x: np.ndarray, entries: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The exact squared distance of every row to its nearest entry; the other arrays are brought up to date."""
    between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    half = _down(_root(between) * (0.5 - _ULPS))
    best = ((x - entries[assigned]) ** 2).sum(axis=1)
    np.minimum(upper, _up(_root(best) * (1 + _ULPS)), out=upper)
    for c in range(len(entries)):
        # Strictly: what is as near as the present entry must be compared, for its index may be lower.
        rows = np.flatnonzero((assigned != c) & (upper >= lower[:, c]) & (upper >= half[assigned, c]))
        if not len(rows):
            continue
        square = ((x[rows] - entries[c]) ** 2).sum(axis=1)
        lower[rows, c] = _down(_root(square) * (1 - _ULPS))
        nearer = (square < best[rows]) | ((square == best[rows]) & (c < assigned[rows]))
        won, gained = rows[nearer], square[nearer]
        lower[won, assigned[won]] = _down(_root(best[won]) * (1 - _ULPS))
        assigned[won], best[won] = c, gained
        upper[won] = _up(_root(gained) * (1 + _ULPS))
    return best


def _scaled(column: pa.Array, scale: int, largest: int) -> np.ndarray:
    """Rows of equal length as integers."""
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() > largest:
        raise ValueError(f"components beyond {largest / scale} cannot be coded exactly")
    return values.astype(np.int64).reshape(len(column), -1)


def _moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each entry of each part moved, at most."""
    return _up(_root(((after - before) ** 2).sum(axis=2)) * (1 + _ULPS))


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, scale: int, keep: bool) -> DataFrame:
    """``rows(vec_id, label, vector, ...)`` with ``error`` and, to ``keep``, the bounds; else with ``code``.

    ``moved`` is given if ``rows`` hold the bounds of a round before.
    """
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    id_kind, label_kind, vector_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label", "vector"))

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _scaled(batch.column(2), scale, _largest(width)).reshape(-1, parts, width)
        bounds = Bounds(len(x), parts, entries)
        if moved is not None:
            bounds.load(batch.columns[3:7], moved)
        error = np.zeros(len(x), dtype=np.int64)
        for p in range(parts):
            part = [bounds.assigned[:, p].astype(np.int64), bounds.upper[:, p].copy(), bounds.lower[:, p].copy()]
            error += _assign_part(x[:, p], shared.value[p], *part)
            bounds.assigned[:, p], bounds.upper[:, p], bounds.lower[:, p] = part
        if keep:
            more = [pa.array(column, pa.binary()) for column in bounds.stored()]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *more], ["vec_id", "label", "vector", "assigned", "upper", "step", "lower"])
        digits = 2 if entries <= 256 else 8
        code = ["".join(f"{c:0{digits}x}" for c in row) for row in bounds.assigned.tolist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield coded(batch.slice(at, _ROWS))

    head = f"vec_id {id_kind}, label {label_kind}"
    return rows.mapInArrow(run, f"{head}, vector {vector_kind}, {_STATE}" if keep else f"{head}, code string, error long")


def _sums(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """``(part, entry, at, total, n)``: what each task's rows, and then all rows, add up to."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _scaled(batch.column(0), scale, _largest(width)).reshape(-1, parts, width)
            kind = np.uint8 if entries <= 256 else np.uint32
            assigned = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind).reshape(-1, parts).astype(np.int64)
            for p in range(parts):
                np.add.at(total[p], assigned[:, p], x[:, p])
                count[p] += np.bincount(assigned[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        at = np.arange(width)
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(at, len(part)), total[part, entry].reshape(-1), np.repeat(count[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "total", "n"])

    found = rows.select("vector", "assigned").mapInArrow(run, "part long, entry long, at long, total long, n long")
    return found.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _means(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries moved to the floor of their parts' mean; unused ones stay."""
    out = books.copy()
    for row in sums.collect():
        out[row["part"], row["entry"], row["at"]] = int(row["total"]) // row["n"]
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``(vec_id, label, vector)`` of the rows whose vector is not null and has finite components only."""
    label = vectors[label_col] if label_col else F.lit(None).cast("int")
    rows = vectors.select(vectors[id_col].alias("vec_id"), label.alias("label"), vectors[vector_col].alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & finite)


def _first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The codebooks of the first rows by id; none without a vector that can be cut evenly."""
    order = [F.asc_nulls_last("vec_id"), "vector"]
    even = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    one = even.orderBy(*order).limit(1).select(F.size("vector").alias("n")).first()
    if one is None:
        return None
    first = even.where(F.size("vector") == one["n"]).orderBy(*order).limit(entries).select("vector").toArrow()
    x = _scaled(first["vector"].combine_chunks(), scale, _largest(one["n"] // parts))
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def fit_and_encode(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray | None]:
    """``usable`` rows to ``(vec_id, label, code, error)`` and the final codebooks, by part, entry and position."""
    none = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    books = _first_books(rows, parts, entries, scale)
    if books is None:
        return none, None
    fits = F.size("vector") == parts * books.shape[2]
    now, moved = rows.where(fits), None
    for _ in range(rounds):
        now = stored(_assigned(now, books, moved, scale, True), "bounds")
        after = _means(books, _sums(now, books, scale))
        books, moved = after, _moved(books, after)
    return _assigned(now, books, moved, scale, False).union(none.where(~fits)), books


def books_digest(books: np.ndarray | None) -> str:
    """The lowercase SHA-256 of all components, by part, entry and position."""
    values = [] if books is None else books.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of equal labels, nulls together, added up; null without any error.

    A label's sum is joined back by its text, and the rows of a label that
    holds many are dealt out.
    """
    kept = stored(codes.withColumn("__label", F.to_json(F.struct("label"))), "codes")
    sums = kept.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return spread_join(kept, sums, ["__label"], ["vec_id"]).drop("__label")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, put together and scaled back."""
    parts = books.shape[0]
    flat = F.array(*(F.array(*(F.array(*map(F.lit, entry)) for entry in part)) for part in (books / scale).tolist()))
    digits = 2 if books.shape[1] <= 256 else 8
    entry = lambda p: F.conv(F.substring("code", 1 + digits * p, digits), 16, 10).cast("int")
    pieces = [F.get(F.get(flat, F.lit(p)), entry(p)) for p in range(parts)]
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.concat(*pieces)))
