"""Language-model scoring by deleted interpolation.

A text's tokens are its words and one end. The model mixes three estimates,

    p(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1),

with weights that depend on the context's frequency bucket (a power of two of
``c(h)``). The weights are learned by expectation-maximisation on held-out
("deleted") counts: each training n-gram is scored by what is left when one of
its occurrences is taken out.

Every word is a context of its own, and so is a text's beginning. A context
that training never saw has no bigram estimate: the other two weights share its
part, so the probabilities of all words and of one unknown word sum to 1.

Scale. Only tables with a fixed bound reach driver or every executor: the
``CONTEXTS`` commonest words with their counts (they only save lookups), and a
grid of the deleted estimates. Counts and lookups go through a shuffle: a task
turns some millions of tokens into sorted, byte-plane packed arrays, one row per
destination, so the shuffle moves a few bytes per distinct (document, context,
word). A pair goes where what is not known of it is counted:

* both words common: by pair, which finds ``c(h, w)``;
* only ``h`` common: by ``w``, which finds ``c(w)`` and ``c(h, w)``;
* only ``w`` common: by ``h``, which finds ``c(h)``, the count of ``h`` as a
  predicted word, and ``c(h, w)``;
* both rare: by ``w`` for ``c(w)`` and by ``h`` for the others; the two halves
  meet again in the batch of documents that asked.

A very common pair is one entry per document and a rare word is at most one
token in ``CONTEXTS``, so no destination is hot. Nothing is capped or sampled.
A batch grows with the number of destinations (``LEAST_ENTRIES``), so there are
never more packed rows than a small share of the tokens.

Words are told apart by a 64-bit hash: among V distinct words the chance that
any two agree is about ``V * V / 2 ** 65`` (3e-8 at a million words, 3e-4 at a
hundred million).

Defined results: a null text counts as an empty one (its end is its only
token); a null id is in the training part; repeated rows are scored each, and
each counts in training; an empty table gives an empty result, and a table
without training rows scores every token by ``1 / (V + 1)`` with ``V = 0``,
that is by probability 1; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mixed, word_hashes
from ..sources.storage import cut

CONTEXTS = 65_536
TOKENS = 600_000  # of one packed batch
LEAST_ENTRIES = 512  # tokens of a batch per destination, at least
TYPES = 1_000_000  # distinct words that a task holds before it passes them on
DEALT = 4  # destinations per shuffle partition
STEP = 4  # cells of the deleted estimates per power of two
BUCKETS = 64
_SLICE = 256
_STRETCH = 1 << 18
_END = np.uint64(0xE0D0E0D0E0D0E0D1)


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes: sorted or small ones then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's position) of every token, ends included."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    first = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    doc = np.searchsorted(first, start, side="right") - 1
    words = np.bincount(doc, minlength=len(raw))
    total = len(start) + len(raw)
    token = np.full(total, _END, dtype=np.uint64)
    token[np.arange(len(start)) + doc] = mixed(word_hashes(data, start, end))
    return token, np.repeat(np.arange(len(raw)), words + 1)


@dataclass
class Contexts:
    """The common words (hashes ascending), their counts, and last the count of beginnings."""

    words: np.ndarray
    counts: np.ndarray
    n: int  # training tokens
    v: int  # distinct ones

    @property
    def begin(self) -> int:
        """The number of the context of a text's beginning."""
        return len(self.words)

    @property
    def rare(self) -> int:
        """The number that stands for any context without a number."""
        return len(self.words) + 1

    def number(self, token: np.ndarray) -> np.ndarray:
        """The numbers of tokens; ``rare`` for others than common words."""
        if not len(self.words):
            return np.full(len(token), self.rare, dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.words, token), len(self.words) - 1)
        return np.where(self.words[at] == token, at, self.rare).astype(np.uint64)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def _unique(*keys: np.ndarray, n: np.ndarray | None = None):
    """Distinct rows of some key columns, ascending, with how often each is found."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(new)
    weight = np.ones(len(order), dtype=np.int64) if n is None else n[order]
    return *(k[begin] for k in keys), np.add.reduceat(weight, begin) if len(begin) else weight[:0]


def _batches(batches, most: int = TOKENS):
    """Some millions of tokens at a time: (ids, held out, tokens, positions)."""
    ids, held, parts, size = [], [], [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, _SLICE):
            part = batch.slice(low, _SLICE)
            token, doc = tokens_of(part.column(2).to_pylist())
            parts.append((token, doc + len(ids)))
            ids += part.column(0).to_pylist()
            held += part.column(1).to_pylist()
            size += len(token)
            if size >= most:
                yield ids, np.array(held, dtype=bool), *map(np.concatenate, zip(*parts, strict=True))
                ids, held, parts, size = [], [], [], 0
    if ids:
        yield ids, np.array(held, dtype=bool), *map(np.concatenate, zip(*parts, strict=True))


def _vocabulary(batches):
    """Words of the training part with their counts, merged over a task's batches as far as memory allows."""

    def row(word, n):
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    held_back = None
    for _, held, token, doc in _batches(batches):
        found = _unique(token[~held[doc]])
        if held_back is not None:
            word, n = map(np.concatenate, zip(held_back, found, strict=True))
            found = _unique(word, n=n)
        held_back = found
        if len(found[0]) > TYPES:
            yield row(*found)
            held_back = None
    if held_back is not None:
        yield row(*held_back)


def _contexts(vocabulary: DataFrame, most: int) -> Contexts:
    """The commonest words: all those with at least some count, found from a histogram of count bins."""
    size = F.floor(F.log2("n") * 16).cast("int")
    bins = vocabulary.groupBy(size.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    room, least = most, None
    for b in sorted(bins, key=lambda r: -r["bin"]):
        room -= b["words"]
        if room < 0:
            break
        least = b["bin"]
    words = vocabulary.where(size >= (least if least is not None else 1 << 30)).select("word", "n").toArrow()
    order = np.argsort(words.column("word").to_numpy().view(np.uint64))
    begins = vocabulary.where(F.col("word") == int(_END.view(np.int64))).agg(F.sum("n")).first()[0] or 0
    return Contexts(
        words.column("word").to_numpy().view(np.uint64)[order],
        np.concatenate([words.column("n").to_numpy().astype(np.int64)[order], [begins]]),
        sum(b["n"] for b in bins),
        sum(b["words"] for b in bins),
    )


#: Packed columns of one destination, and the integers in them. ``a_``: both words common; ``w_``: rare words with the
#: number of their context; ``h_``: rare contexts with the number or hash of their word. ``_at`` is 0, or one more than
#: the entry's place among its batch's pairs of two rare words.
_COLUMNS = {
    "a_pair": np.uint64, "a_doc": np.uint32, "a_n": np.uint32,
    "w_word": np.uint64, "w_context": np.uint32, "w_doc": np.uint32, "w_n": np.uint32, "w_at": np.uint32,
    "h_context": np.uint64, "h_word": np.uint64, "h_doc": np.uint32, "h_n": np.uint32, "h_at": np.uint32,
}
_PACKED = "part int, batch long, " + ", ".join(f"{name} binary" for name in _COLUMNS) + ", far_doc binary, far_n binary"


def _entries(contexts: Contexts, token, doc, ref, use):
    """The columns of all entries of a batch, without destinations, and (document, n) of its pairs of two rare words."""
    number = contexts.number(token)
    begins = np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)]
    context = np.concatenate((number[:1], number[:-1]))
    context[begins] = contexts.begin
    before = np.concatenate((token[:1], token[:-1]))
    rare_w, rare_h = number == contexts.rare, context == contexts.rare
    a, b, c = use & ~rare_w & ~rare_h, use & rare_w, use & ~rare_w & rare_h
    pair, a_doc, a_n = _unique(context[a] << np.uint64(17) | number[a], ref[a])
    # Contexts with a number and hashed ones are told apart by the first key.
    far, word, after, w_doc, w_n = _unique(rare_h[b], token[b], np.where(rare_h[b], before[b], context[b]), ref[b])
    at = np.where(far, np.cumsum(far), 0).astype(np.uint32)
    h_context, h_word, h_doc, h_n = _unique(before[c], number[c], ref[c])
    columns = {
        "a_pair": pair, "a_doc": a_doc, "a_n": a_n,
        "w_word": word, "w_context": np.where(far, contexts.rare, after), "w_doc": w_doc, "w_n": w_n, "w_at": at,
        "h_context": np.concatenate((h_context, after[far])), "h_word": np.concatenate((h_word, word[far])),
        "h_doc": np.concatenate((h_doc, w_doc[far])), "h_n": np.concatenate((h_n, w_n[far])),
        "h_at": np.concatenate((np.zeros(len(h_n), dtype=np.uint32), at[far])),
    }
    return columns, w_doc[far], w_n[far]


def _deal(contexts: Contexts, parts: int, with_docs: bool, id_type: pa.DataType):
    """Documents to packed rows, one per destination and batch of tokens.

    A document's reference is its position in the batch, doubled, plus one if
    it is held out. One row of a batch, its lead, also carries what needs no
    lookup.
    """
    keys = {"a": "a_pair", "w": "w_word", "h": "h_context"}

    def run(batches):
        for seq, (ids, held, token, doc) in enumerate(_batches(batches, max(TOKENS, LEAST_ENTRIES * parts))):
            batch = (TaskContext.get().partitionId() << 32) | seq
            use = np.ones(len(token), dtype=bool) if with_docs else ~held[doc]
            ref = (doc * 2 + held[doc]).astype(np.uint32) if with_docs else np.zeros(len(doc), dtype=np.uint32)
            columns, far_doc, far_n = _entries(contexts, token, doc, ref, use)
            order, edge = {}, {}
            for group, key in keys.items():
                to = (mixed(columns[key]) % np.uint64(parts)).astype(np.int64)
                order[group] = np.argsort(to, kind="stable")
                edge[group] = np.searchsorted(to[order[group]], np.arange(parts + 1))
            lead = batch % parts
            rows, leads = [], []
            for p in range(parts):
                span = {g: order[g][edge[g][p] : edge[g][p + 1]] for g in keys}
                if p != lead and not any(map(len, span.values())):
                    continue
                own = [_packed(far_doc.astype(np.uint32)), _packed(far_n.astype(np.uint32))] if p == lead else [None, None]
                packed = [_packed(columns[name][span[name[0]]].astype(kind)) for name, kind in _COLUMNS.items()]
                rows.append((p, batch, *packed, *own))
                leads.append(p == lead)
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])]
            names = [c.split()[0] for c in _PACKED.split(", ")]
            if with_docs:
                number = contexts.number(token)
                common = number < len(contexts.words)
                seen = contexts.counts[number[common].astype(np.int64)]
                base = np.bincount(doc[common], np.log10((seen + 1) / (contexts.n + contexts.v + 1)), len(ids))
                carried = [ids, held, np.bincount(doc, minlength=len(ids)), np.bincount(doc[common], minlength=len(ids)), base]
                for values, (name, kind) in zip(carried, _own(id_type), strict=True):
                    arrays.append(pa.array([values if x else None for x in leads], pa.list_(kind)))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _read(batches):
    """All packed rows of a task."""
    rows = []
    for batch in batches:
        for row in batch.to_pylist():
            row |= {name: _unpacked(row[name], kind) for name, kind in _COLUMNS.items()}
            rows.append(row)
        del batch
    return rows


def _totals(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of n over entries with the same key, for each entry."""
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    sums = np.add.reduceat(n[order], begin) if len(begin) else n
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(begin, len(key))))
    return out


@dataclass
class Found:
    """Entries with what their destination found: counts of context, word and pair (-1: counted elsewhere)."""

    total: np.ndarray
    count: np.ndarray
    times: np.ndarray
    n: np.ndarray
    doc: np.ndarray  # the number of the entry's row times 2**32 plus the document's position there
    at: np.ndarray
    own_word: bool  # whether c(w) was counted here


def _gathered(rows, contexts: Contexts):
    """``Found`` of each kind of entry. Columns are let go as they are read."""

    def cat(name):
        return np.concatenate([np.zeros(0, _COLUMNS[name]), *(r.pop(name) for r in rows)])

    def docs(name):
        ref = [r.pop(name) for r in rows]
        at = np.concatenate([np.zeros(0, np.int64), *((np.int64(i) << 32) + (x >> np.uint32(1)) for i, x in enumerate(ref))])
        return at, np.concatenate([np.zeros(0, bool), *(x & np.uint32(1) == 0 for x in ref)])

    n, (doc, taught) = cat("a_n"), docs("a_doc")
    pair = cat("a_pair")
    times = _totals(pair, np.where(taught, n, 0).astype(np.int64))
    number = (pair & np.uint64((1 << 17) - 1)).astype(np.int64)
    context = (pair >> np.uint64(17)).astype(np.int64)
    del pair, taught
    yield Found(contexts.counts[context], contexts.counts[number], times, n, doc, np.zeros(len(n), np.uint32), False)
    del context, number, times
    n, (doc, taught) = cat("w_n"), docs("w_doc")
    context, word, at = cat("w_context").astype(np.int64), cat("w_word"), cat("w_at")
    seen = np.where(taught, n, 0).astype(np.int64)
    count = _totals(word, seen)
    words, where = np.unique(word, return_index=True)
    counts = count[where]
    # A word's contexts, told apart by a hash of both; a rare context's pairs are counted where it is.
    far = at > 0
    times = _totals(mixed(mixed(word) + context.astype(np.uint64)), seen)
    total = contexts.counts[np.minimum(context, contexts.begin)]
    yield Found(np.where(far, -1, total), count, np.where(far, -1, times), n, doc, at, True)
    del context, word, times, total, count
    n, (doc, taught) = cat("h_n"), docs("h_doc")
    context, word, at = cat("h_context"), cat("h_word"), cat("h_at")
    place = np.minimum(np.searchsorted(words, context), max(0, len(words) - 1))
    total = np.where(words[place] == context, counts[place], 0) if len(words) else np.zeros(len(n), dtype=np.int64)
    far = at > 0
    key = mixed(mixed(context) + word + np.where(far, np.uint64(0), np.uint64(_COMMON)))
    times = _totals(key, np.where(taught, n, 0).astype(np.int64))
    near = contexts.counts[np.where(far, 0, word).astype(np.int64)]
    yield Found(total, np.where(far, -1, near), times, n, doc, at, False)


_COMMON = 0x5851F42D4C957F2D  # tells numbers of words from their hashes
_HALVES = "batch long, far_at binary, far_total binary, far_times binary, far_count binary"


def _halves(found: list[Found], rows) -> list[list]:
    """For each row what was found here of its batch's pairs of two rare words: (at, total, times, count), packed."""
    at, row, total, times, count = (
        np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in column)])
        for column in zip(*(
            ((f.at - 1)[k], (f.doc >> 32)[k], f.total[k], f.times[k], f.count[k]) for f in found for k in [f.at > 0]
        ), strict=True)
    )
    order = np.argsort(row, kind="stable")
    edge = np.searchsorted(row[order], np.arange(len(rows) + 1))
    return [[_packed(x[order[a:b]]) for x in (at, total, times, count)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _whole(parts, n: int):
    """(total, count, times) of a batch's pairs of two rare words, from their packed halves."""
    total, times, count = (np.full(n, -1, dtype=np.int64) for _ in range(3))
    for at, *values in parts:
        at = _unpacked(at, np.int64)
        for out, found in zip((total, times, count), values, strict=True):
            np.maximum.at(out, at, _unpacked(found, np.int64))  # a pair's two halves may have met in one task
    return total, count, times


def _cells(contexts: Contexts, total, count, times, n):
    """Counts to cells of deleted estimates: bucket, bigram and unigram cell in one number, and weights."""

    def cell(p):
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEP), -1).astype(np.int64)

    p2 = np.where(total > 1, (times - 1) / np.maximum(total - 1, 1), 0.0)
    p1 = (count - 1) / max(contexts.n - 1, 1)
    return (_bucket(total) * 512 + cell(p2) + 1) * 512 + cell(p1) + 1, n.astype(np.int64)


_GRID = f"cell long, weight long, far_n binary, {_HALVES}"


def _grid_rows(key=(), weight=(), halves=()):
    """Rows of ``_GRID``: cells, or halves of pairs with their batch and, in its lead, their weights."""
    cells, which = np.unique(np.asarray(key, dtype=np.int64), return_inverse=True)
    sums = np.bincount(which, np.asarray(weight, dtype=np.float64), len(cells)).astype(np.int64)
    rows = list(halves)
    columns = [pa.array([*cells.tolist(), *[None] * len(rows)], pa.int64()), pa.array([*sums.tolist(), *[None] * len(rows)], pa.int64())]
    names = [c.split()[0] for c in _GRID.split(", ")]
    for i, name in enumerate(names[2:]):
        kind = pa.int64() if name == "batch" else pa.binary()
        columns.append(pa.array([*[None] * len(cells), *(r[i] for r in rows)], kind))
    return pa.RecordBatch.from_arrays(columns, names)


def _deleted(contexts: Contexts):
    """A task's packed rows to ``_GRID``."""

    def run(batches):
        rows = _read(batches)
        if not rows:
            return
        lead = [r["far_n"] for r in rows]
        found = list(_gathered(rows, contexts))
        near = [_cells(contexts, f.total[k], f.count[k], f.times[k], f.n[k]) for f in found for k in [f.at == 0]]
        key, weight = (np.concatenate(x) for x in zip(*near, strict=True))
        halves = _halves(found, rows)
        yield _grid_rows(key, weight, [(n, r["batch"], *h) for n, r, h in zip(lead, rows, halves, strict=True) if n or h[0]])

    return run


def _deleted_far(contexts: Contexts):
    """Halves of pairs, all of a batch in one task, to their cells."""

    def run(batches):
        parts, weights = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                parts.setdefault(r["batch"], []).append([r["far_at"], r["far_total"], r["far_times"], r["far_count"]])
                if r["far_n"]:
                    weights[r["batch"]] = _unpacked(r["far_n"], np.uint32)
        found = [_cells(contexts, *_whole(parts[b], len(n)), n) for b, n in weights.items()]
        if found:
            yield _grid_rows(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def mixture_weights(cells, weights, v: int, rounds: int = 100) -> np.ndarray:
    """``(bucket, 3)`` weights of bigram, unigram and uniform estimates, by expectation-maximisation."""
    cells, weights = np.asarray(cells, dtype=np.int64), np.asarray(weights, dtype=np.float64)
    bucket, c2, c1 = cells // 512 // 512, cells // 512 % 512 - 1, cells % 512 - 1
    value = lambda c: np.where(c >= 0, 2.0 ** (-c / STEP), 0.0)
    p = np.stack([value(c2), value(c1), np.full(len(cells), 1 / (v + 1))], axis=1)

    def learn(pick):
        mix = np.full(3, 1 / 3)
        for _ in range(rounds):
            joint = p[pick] * mix
            share = joint / joint.sum(axis=1, keepdims=True) * weights[pick, None]
            mix = (share.sum(axis=0) + 0.5) / (share.sum() + 1.5)  # a half count keeps every estimate alive
        return mix

    if not len(cells):  # nothing to learn from: everything is as likely as an unknown word
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    out = np.tile(learn(np.ones(len(cells), dtype=bool)), (BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = learn(bucket == b)
    out[0, 0] = 0.0  # a context without counts has no bigrams
    out[0] /= out[0].sum()
    return out


def _own(id_type: pa.DataType) -> list[tuple[str, pa.DataType]]:
    """What one row of a batch carries for its documents, beside what is looked up."""
    return [("ids", id_type), ("held", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64())]


def _log_p(contexts: Contexts, mix: np.ndarray, total, count, times, n) -> np.ndarray:
    """The log10 probability of all n occurrences."""
    out = np.empty(len(n))
    for low in range(0, len(n), _STRETCH):
        cut = slice(low, low + _STRETCH)
        part = mix[_bucket(total[cut])]
        p = part[:, 0] * times[cut] / np.maximum(total[cut], 1) + part[:, 1] * (count[cut] / max(contexts.n, 1))
        out[cut] = n[cut] * np.log10(p + part[:, 2] / (contexts.v + 1))
    return out


_PARTIAL = "place binary, score binary, part_base binary, part_known binary, far_doc binary, far_n binary"


def _scored(contexts: Contexts, mix: np.ndarray, id_type: pa.DataType):
    """A task's packed rows to partial sums by document, one row per batch."""

    def run(batches):
        rows = _read(batches)
        if not rows:
            return
        sums, held_back = [], []
        for f in _gathered(rows, contexts):
            near = f.at == 0
            log_p = np.zeros(len(f.n))
            log_p[near] = _log_p(contexts, mix, f.total[near], f.count[near], f.times[near], f.n[near])
            doc, which = np.unique(f.doc, return_inverse=True)
            score = np.bincount(which, log_p, len(doc))
            base, known = np.zeros(len(doc)), np.zeros(len(doc))
            if f.own_word:
                base = np.bincount(which, f.n * np.log10((f.count + 1) / (contexts.n + contexts.v + 1)), len(doc))
                known = np.bincount(which, f.n * (f.count > 0), len(doc))
            sums.append((doc, score, base, known))
            far = ~near
            held_back.append(Found(*(x[far] for x in (f.total, f.count, f.times, f.n, f.doc, f.at)), f.own_word))
            del f, log_p, which
        doc, *values = (np.concatenate(x) for x in zip(*sums, strict=True))
        doc, which = np.unique(doc, return_inverse=True)
        score, base, known = (np.bincount(which, v, len(doc)) for v in values)
        cut_at = np.searchsorted(doc >> 32, np.arange(len(rows) + 1))
        for i, (r, half) in enumerate(zip(rows, _halves(held_back, rows), strict=True)):
            span = slice(cut_at[i], cut_at[i + 1])
            packed = [
                _packed((doc[span] & 0xFFFFFFFF).astype(np.uint32)), _packed(score[span]), _packed(base[span]),
                _packed(known[span].astype(np.uint32)),
            ]
            binary = [*half, *packed, r["far_doc"], r["far_n"]]
            names = [c.split()[0] for c in f"{_HALVES}, {_PARTIAL}".split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["batch"]]), *(pa.array([x], pa.binary()) for x in binary), *(pa.array([r[name]], pa.list_(kind)) for name, kind in _own(id_type))],
                [*names, *(name for name, _ in _own(id_type))],
            )

    return run


def _merged(contexts: Contexts, mix: np.ndarray, id_type: pa.DataType):
    """The partial sums of whole batches to one row per document."""

    def run(batches):
        sums, own, halves = {}, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                place = _unpacked(row["place"], np.uint32).astype(np.int64)
                size = int(place.max()) + 1 if len(place) else 0
                if row["ids"] is not None:
                    own[row["batch"]] = row
                    size = len(row["ids"])
                total = sums.get(row["batch"], np.zeros((3, 0)))
                if size > total.shape[1]:
                    total = np.pad(total, ((0, 0), (0, size - total.shape[1])))
                for i, (name, kind) in enumerate((("score", np.float64), ("part_base", np.float64), ("part_known", np.uint32))):
                    total[i, place] += _unpacked(row[name], kind)  # a place is found once in a row
                sums[row["batch"]] = total
                halves.setdefault(row["batch"], []).append([row[x] for x in ("far_at", "far_total", "far_times", "far_count")])
        for number, row in own.items():
            score, base, known = sums[number]
            doc, n = (_unpacked(row[x], np.uint32).astype(np.int64) for x in ("far_doc", "far_n"))
            score += np.bincount(doc >> 1, _log_p(contexts, mix, *_whole(halves[number], len(n)), n), len(score))
            columns = [
                pa.array(row["ids"], id_type), pa.array(row["held"], pa.bool_()), pa.array(row["tokens"], pa.int64()),
                pa.array(known.astype(np.int64) + np.array(row["known"], dtype=np.int64)),
                pa.array(base + np.array(row["base"])), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    ``held_out`` is a Boolean column of ``docs``: rows to score but not to
    learn from (null: learn). Scores are log10 probabilities of whole texts;
    the base is a unigram model with one added to every count.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    picked = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), docs[text_col].alias("text")
    )
    # A destination gathers all its entries in Python, so it gets a part of what a shuffle partition would.
    parts = DEALT * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    vocabulary = cut(
        picked.mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    known = _contexts(vocabulary, min(contexts, 65_536))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    found = cut(
        picked.mapInArrow(_deal(known, parts, False, id_type), _PACKED).repartition(parts, "part")
        .mapInArrow(_deleted(known), _GRID)
    )
    far = found.where("batch is not null").repartition(parts, "batch").mapInArrow(_deleted_far(known), _GRID)
    cells = found.where("cell is not null").select("cell", "weight").union(far.select("cell", "weight"))
    grid = cells.groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
    mix = mixture_weights(grid.column("cell").to_numpy(), grid.column("weight").to_numpy(), known.v)
    own = f"ids array<{kind.simpleString()}>, held array<boolean>, tokens array<long>, known array<long>, base array<double>"
    partial = f"{_HALVES}, {_PARTIAL}"
    scored = (
        picked.mapInArrow(_deal(known, parts, True, id_type), f"{_PACKED}, {own}")
        .repartition(parts, "part")
        .mapInArrow(_scored(known, mix, id_type), f"{partial}, {own}")
        .repartition(parts, "batch")
        .mapInArrow(
            _merged(known, mix, id_type),
            f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", "score"
    )
