"""SimHash near-dedup with a pigeonring filter.

A text's fingerprint has 64 bits; a bit is set when it is set in over half of
the hashes of the text's word shingles. Two fingerprints within ``max_bits``
differing bits are linked.

Candidates: the 64 bits are cut into ``m`` segments on a ring. If two
fingerprints differ in at most ``t`` bits, the ring has a segment from which
every chain of ``l`` consecutive segments differs in at most ``l * t / m`` bits
(the pigeonring principle). With ``m > t`` that chain's first segment is equal
and ``m - t`` segments are equal in all, so each fingerprint is put under one key
per set of ``m - t`` segments. Inside a key, the cumulative differences along the
ring prune pairs before the full Hamming check, and a pair counts only under the
one key that its first viable chain names: that segment and the next equal ones.

Scale: equal fingerprints are one row before any key is made, so copies cost
nothing. A key has ``64 * (m - t) / m`` bits, and ``m`` follows the number of
distinct fingerprints (``segments_for``), so keys hold a handful each at any
size. Keys with over about ``BLOCK`` fingerprints are cut into blocks, and each
pair of blocks is one bounded group: the links stay whole while no task holds
more than two blocks. A big group yields a spanning forest of its links (enough
for components), not its pairs.

Defined results: a null text counts as an empty one; texts without words have
fingerprint zero and link like any other; texts with fewer words than a shingle
are hashed whole; ids may repeat (each row is returned) or be null (a null id
never names a component); with a similarity, nodes are texts, so rows with null
or repeated ids are grouped by their texts like any other; an empty table gives an empty result; columns other
than the id and the text are not read by ``simhash_groups``.
"""

from __future__ import annotations

import itertools
from collections import deque
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import mixed, word_hashes
from ..sources.storage import cut, released, stored

BITS = 64
SEED = 42
BLOCK = 4096
SMALL = 48
PART = 16  # of so many parts one is counted to find the keys that need blocks
LISTED = 10_000  # keys that a broadcast may hold; more are joined by a shuffle
LISTED_NODES = 1_000_000  # nodes, eight bytes each, that a broadcast may hold; more are joined by a shuffle
COMMON = 100_000  # common shingles that go to every task, to be put last in the order of shingles
SHARED_NAMES = 10_000  # far more than 64-bit names of 10^11 texts are expected to be shared
SEEN = 1_000_000  # texts that a task knows again
STARS = 3
BRIEF = 1024  # bins of the odd sketches that rows of a shingle carry
MAX_BITS = 4  # of the SimHashes that name the first candidates of similar texts
_FAMILY, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_SLICE = 256  # texts at a time
_ROWS = 512  # rows of an Arrow batch


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of so many words, repeats included; of the whole sequence if it is shorter."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)] if parts else [], dtype="<u8")
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    end = np.cumsum(size)
    starts, ends = (end - size)[: len(parts) - words + 1].tolist(), (end[words - 1 :] - 1).tolist()
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=len(starts)
    )


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), 65536):
        rows = hashes[low : low + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int) -> int:
    """The text's SimHash over shingles of so many words, as an unsigned integer; 0 without words."""
    return _majority(_shingle_hashes(text, words))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, families: int = 1
) -> DataFrame:
    """``(doc_id, fp0, fp1, ...)``: one signed 64-bit column per hash family. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.empty((families, batch.num_rows), dtype=np.uint64)
            for low in range(0, batch.num_rows, _SLICE):
                for i, text in enumerate(batch.column(1).slice(low, _SLICE).to_pylist(), low):
                    hashes = _shingle_hashes(text, words)
                    for f in range(families):  # further families scramble the same hashes
                        found[f, i] = _majority(mixed(hashes ^ np.uint64(f * _FAMILY & _ALL)) if f else hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(row.view(np.int64)) for row in found)],
                ["doc_id", *(f"fp{f}" for f in range(families))],
            )

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"fp{f} long" for f in range(families)))


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edge = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def segments_for(n: int, max_bits: int) -> int:
    """The fewest segments whose keys split n fingerprints into groups of a few (at most ``max_bits + 5``)."""
    for m in range(max_bits + 2, max_bits + 5):
        if n <= 2 ** (BITS * (m - max_bits) // m + 3):
            return m
    return max_bits + 5


def key_names(segments: int, max_bits: int) -> dict[tuple[int, ...], int]:
    """Sets of segments that may be equal together, with the number of their key."""
    if segments <= max_bits:
        raise ValueError("the pigeonring filter needs more segments than bits that may differ")
    return {chosen: i for i, chosen in enumerate(itertools.combinations(range(segments), segments - max_bits))}


def _key_width(segments: int, max_bits: int) -> int:
    return max(w for _, w in _cuts(segments)) * (segments - max_bits)


def segment_keys(fp, segments: int, max_bits: int):
    """The keys of a fingerprint column: the values of each set of segments, behind the set's number."""
    cuts = _cuts(segments)
    value = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in cuts]
    width = max(w for _, w in cuts)
    keys = []
    for chosen, number in key_names(segments, max_bits).items():
        key = F.lit(number).cast("long")
        for at in chosen:
            key = F.shiftleft(key, width) + value[at]
        keys.append(key)
    return keys


def ring_filter(diff: np.ndarray, number: np.ndarray, segments: int, max_bits: int) -> np.ndarray:
    """Which XORs of pairs pass the chain budgets and belong to the key of this number."""
    parts = np.stack(
        [np.bitwise_count(diff >> np.uint64(s) & np.uint64((1 << w) - 1)) for s, w in _cuts(segments)]
    ).astype(np.int16)
    equal = segments - max_bits
    names = np.full(1 << segments, -1, dtype=np.int64)
    for chosen, i in key_names(segments, max_bits).items():
        names[sum(1 << at for at in chosen)] = i
    open_ = np.ones(len(diff), dtype=bool)
    out = np.zeros(len(diff), dtype=bool)
    for first in range(segments):
        viable = open_.copy()
        total = np.zeros(len(diff), dtype=np.int16)
        for length in range(1, segments + 1):
            total += parts[(first + length - 1) % segments]
            viable &= total <= length * max_bits // segments
            if not viable.any():
                break
        if not viable.any():
            continue
        chosen, many = np.full(len(diff), 1 << first, dtype=np.int64), np.ones(len(diff), dtype=np.int64)
        for step in range(1, segments):
            at = (first + step) % segments
            take = (parts[at] == 0) & (many < equal)
            chosen |= take.astype(np.int64) << at
            many += take
        out |= viable & (names[chosen] == number)
        open_ &= ~viable  # the pair's first viable chain names its key
    return out


def _near(diff: np.ndarray, number: np.ndarray, segments: int, max_bits: int) -> np.ndarray:
    """``ring_filter`` behind a cheap first cut of far pairs."""
    out = np.bitwise_count(diff) <= 4 * max_bits
    pick = np.flatnonzero(out)
    out[pick] = ring_filter(diff[pick], number[pick], segments, max_bits)
    return out


def _forest(fps: np.ndarray, number: np.ndarray, segments: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one group: each found fingerprint is compared with those not yet found."""
    rest = np.arange(len(fps))
    links = []
    while len(rest):
        front, rest = deque([rest[0]]), rest[1:]
        while front and len(rest):
            at = front.popleft()
            near = _near(fps[rest] ^ fps[at], number[rest], segments, max_bits)
            if near.any():
                links += [(at, x) for x in rest[near]]
                front.extend(rest[near].tolist())
                rest = rest[~near]
    return links


def _linker(segments: int, max_bits: int):
    """A function on sorted Arrow batches (key, block_a, block_b, fp, node) that yields links."""
    shift = np.int64(_key_width(segments, max_bits))

    def links_of(key, block_a, block_b, fp, node):
        new = np.flatnonzero(np.diff(key) | np.diff(block_a) | np.diff(block_b)) + 1
        edge = np.concatenate(([0], new, [len(key)]))
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        a, b = [], []
        small = size[group] <= SMALL
        at = np.flatnonzero(small & (size[group] > 1))
        for step in range(1, SMALL):
            at = at[at + step < len(key)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            pick = np.flatnonzero(_near(fp[at] ^ fp[at + step], key[at] >> shift, segments, max_bits))
            a.append(node[at[pick]])
            b.append(node[at[pick] + step])
        for g in np.flatnonzero(size > SMALL):
            lo, hi = edge[g], edge[g + 1]
            found = np.array(_forest(fp[lo:hi], key[lo:hi] >> shift, segments, max_bits), dtype=np.int64).reshape(-1, 2)
            a.append(node[lo:hi][found[:, 0]])
            b.append(node[lo:hi][found[:, 1]])
        return np.concatenate([*a, node[:0]]), np.concatenate([*b, node[:0]])

    def run(batches):
        held = None  # the last group may go on in the next batch
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[3] = cols[3].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut_at = last[-1] + 1 if len(last) else 0
            held = [c[cut_at:] for c in cols]
            if cut_at:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, links_of(*(c[:cut_at] for c in cols)))), ["a", "b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, links_of(*held))), ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int, segments: int | None = None) -> DataFrame:
    """``fps(fp, node)`` with distinct ``fp`` to ``links(a, b)`` between nodes.

    Holds every link of groups up to ``SMALL`` and, of larger groups, enough
    links to join what is linked in them. ``segments`` follow the number of
    fingerprints if none are given.
    """
    segments = segments or segments_for(fps.count(), max_bits)
    keys = F.array(*segment_keys(F.col("fp"), segments, max_bits))
    rows = fps.select("fp", "node", F.explode(keys).alias("key"))
    # Which keys need blocks shows in a part of the fingerprints; every row is dealt all the same.
    some = rows.where(F.pmod(F.xxhash64("fp"), F.lit(PART)) == 0)
    heavy = (
        some.groupBy("key").agg((F.count("*") * PART).alias("n")).where(F.col("n") > BLOCK)
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    listed = heavy.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:  # a bounded list can go to every task
        schema = "key long, blocks int"
        heavy = F.broadcast(fps.sparkSession.createDataFrame([(r["key"], r["blocks"]) for r in listed], schema))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(heavy, "key", "left")
        .withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(own))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select(
            "key", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "fp", "node"
        )
    )
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    grouped = dealt.repartition(parts, "key", "block_a", "block_b").sortWithinPartitions("key", "block_a", "block_b", "node")
    return grouped.mapInArrow(_linker(segments, max_bits), "a long, b long")


def odd_sketch(token: np.ndarray, bins: int | None = None) -> np.ndarray:
    """Packed bits that say which of two to four bins per shingle (or of so many in all) hold an odd number of a set's shingles.

    The XOR of two sketches has at most as many bits as the sets have shingles
    in only one of them. A sketch folds to half its bins by the XOR of its halves.
    """
    bins = bins or max(BITS, 1 << (2 * len(token) - 1).bit_length())
    odd = np.bincount((token & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def _sketches_may_match(x: np.ndarray, size_x: int, y: np.ndarray, size_y: int, least: float) -> bool:
    """Whether the sets may have Jaccard similarity ``least``; never false for those that do."""
    short, long = sorted((x, y), key=len)
    folded = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
    differing = int(np.bitwise_count(folded ^ short).sum())
    return differing * (1 + least) <= (1 - least) * (size_x + size_y) + 1e-9


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``docs(node, text)`` to ``(node, size, sketch, brief)``, one row per node: how many distinct shingles, their odd
    sketch, and one of ``BRIEF`` bins, whatever their number."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                part = batch.slice(low, _SLICE)
                found = [shingles(text, words) for text in part.column(1).to_pylist()]
                told = [pa.array([odd_sketch(x, bins).tobytes() for x in found], pa.binary()) for bins in (None, BRIEF)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, found), pa.int64()), *told], ["node", "size", "sketch", "brief"]
                )

    return docs.mapInArrow(run, "node long, size long, sketch binary, brief binary").dropDuplicates(["node"])


def _maybe_similar(links: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The links that ``known``'s sketches do not rule out: few of what is left is far from similar."""

    def run(batches):
        for batch in batches:
            keep = [
                _sketches_may_match(
                    np.frombuffer(row["x"], dtype=np.uint8), row["size_x"], np.frombuffer(row["y"], dtype=np.uint8), row["size_y"], least
                )
                for low in range(0, batch.num_rows, _SLICE) for row in batch.slice(low, _SLICE).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(end, size, sketch):
        return known.select(F.col("node").alias(end), F.col("size").alias(size), F.col("sketch").alias(sketch))

    both = links.join(side("a", "size_x", "x"), "a").join(side("b", "size_y", "y"), "b")
    return both.select("a", "b", "size_x", "x", "size_y", "y").mapInArrow(run, "a long, b long")


def _similar(links: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The links whose texts share at least ``least`` of their distinct shingles (Jaccard); ``docs(node, text)``.

    Only the texts of links are shuffled: once by their own node, and once more
    for each link to its other end. The list of nodes goes to every task if it
    is short, so that the other texts stay where they are.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    ends = F.broadcast(ends) if ends.count() <= LISTED_NODES else ends

    def compare(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                part, known, keep = batch.slice(low, _SLICE), {}, []
                for row in part.to_pylist():
                    for node, text in ((row["a"], row["x"]), (row["b"], row["y"])):
                        if node not in known:
                            known[node] = shingles(text, words)
                    x, y = known[row["a"]], known[row["b"]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared >= least * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    both = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """What is planned inside gives Python so many rows at a time: whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles, split and folded as for fingerprints; one for all texts without words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    blank = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    if not len(edge):
        return np.zeros(1, dtype=np.uint64)
    word = mixed(word_hashes(data, edge[0::2], edge[1::2]))
    size = min(words, len(word))
    last = len(word) - size + 1
    out = word[:last]
    for i in range(1, size):
        out = mixed(out * np.uint64(_FAMILY) + word[i : last + i])
    return np.unique(out)


def _overlap(x, y, least: float):
    """How many shingles sets of these sizes must share; the small term keeps rounding from asking for one more."""
    return np.ceil(least / (1 + least) * (x + y) - 1e-9)


def _may_be_similar(size_x, at_x, size_y, at_y, least: float):
    """Whether two sets whose first common shingle is at these places can share enough."""
    return np.minimum(size_x - at_x, size_y - at_y) >= _overlap(size_x, size_y, least)


def _prefixes(words: int, least: float, common: np.ndarray, rank: np.ndarray):
    """Arrow batches (node, text) to (token, node, size, at): the shingles of which similar sets share one.

    In one order of all shingles, two sets with Jaccard similarity ``least``
    share one of their first ``n - ceil(least * n) + 1``. Any order is right;
    common shingles come last, so that few sets meet under one.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                part, out = batch.slice(low, _SLICE), []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if node in seen:
                        continue  # a copy; those of other tasks go when their rows meet
                    if len(seen) < SEEN:
                        seen.add(node)
                    token = shingles(text, words)
                    n = len(token)
                    if len(common):
                        place = np.minimum(np.searchsorted(common, token), len(common) - 1)
                        weight = np.where(common[place] == token, rank[place], 0)
                        token = token[np.argsort(weight, kind="stable")]
                    token = token[: n - int(np.ceil(least * n - 1e-9)) + 1]
                    out.append((token, np.full(len(token), node), np.full(len(token), n), np.arange(len(token))))
                if out:
                    token, node, size, at = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token.view(np.int64)), pa.array(node.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))],
                        ["token", "node", "size", "at"],
                    )

    return run


def _met(batches):
    """Rows sorted by (token, node) without repeats and without tokens of a single node."""
    held = None  # the last row, and whether an earlier one has its token
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held[0], cols, strict=True)]
        fresh = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        cols = [c[fresh] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        before = np.concatenate(([held is not None and held[1]], same))
        keep = (before | np.concatenate((same, [False])))[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in cols], ["token", "node", "size", "at"])
        held = [c[-1:] for c in cols], bool(before[-1])
    if held is not None and held[1]:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["token", "node", "size", "at"])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _stars(least: float):
    """Rows (token, node, size, at, component), sorted by token, to pairs of each token's first row with its others."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            token, node, size, at, part = cols
            start = np.maximum.accumulate(np.where(np.concatenate(([True], token[1:] != token[:-1])), np.arange(len(token)), 0))
            pick = (part != part[start]) & _may_be_similar(size, at, size[start], at[start], least)
            yield _pairs(node[pick], node[start[pick]])
            held = [c[start[-1] : start[-1] + 1] for c in cols]

    return run


def _cross(least: float):
    """Rows (token, block_a, block_b, own, node, size, at, component, brief), sorted by the first three, to their pairs that
    may be similar. Most of a large group's are not, so their sketches are compared here, where no pair is a row yet."""

    def pairs_of(token, block_a, block_b, own, node, size, at, part, brief):
        def good(i, j):
            ok = (part[i] != part[j]) & ((block_a[i] == block_b[i]) | (own[i] != own[j]))
            ok &= _may_be_similar(size[i], at[i], size[j], at[j], least)
            left = np.flatnonzero(ok)
            x, y = (i[left] if isinstance(i, np.ndarray) else i), j[left]
            differing = np.bitwise_count(brief[x] ^ brief[y]).sum(axis=1)
            ok[left] = differing * (1 + least) <= (1 - least) * (size[x] + size[y]) + 1e-9
            return ok

        new = np.flatnonzero((token[1:] != token[:-1]) | (block_a[1:] != block_a[:-1]) | (block_b[1:] != block_b[:-1])) + 1
        edge = np.concatenate(([0], new, [len(token)]))
        many = np.diff(edge)
        group = np.repeat(np.arange(len(many)), many)
        i = np.flatnonzero((many[group] <= SMALL) & (many[group] > 1))
        for step in range(1, SMALL):
            i = i[i + step < len(token)]
            i = i[group[i] == group[i + step]]
            if not len(i):
                break
            pick = i[good(i, i + step)]
            yield _pairs(node[pick], node[pick + step])
        for g in np.flatnonzero(many > SMALL):
            a, b = [], []
            for i in range(edge[g], edge[g + 1] - 1):
                j = np.arange(i + 1, edge[g + 1])
                j = j[good(i, j)]
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
                if len(a) == SMALL:  # bounded batches, whatever the group's size
                    yield _pairs(np.concatenate(a), np.concatenate(b))
                    a, b = [], []
            if a:
                yield _pairs(np.concatenate(a), np.concatenate(b))

    def run(batches):
        held = None  # the last group may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns[:-1]]
            cols.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), dtype=np.uint64).reshape(-1, BRIEF // 64))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut_at = other[-1] + 1 if len(other) else 0
            held = [c[cut_at:] for c in cols]
            if cut_at:
                yield from pairs_of(*(c[:cut_at] for c in cols))
        if held is not None:
            yield from pairs_of(*held)

    return run


def similar_components(docs: DataFrame, words: int, least: float) -> DataFrame:
    """``docs(node, text)``, a text's copies under one node, to ``(node, component)`` of the linked nodes.

    Links are all pairs of texts with Jaccard similarity ``least`` or more of
    their distinct shingles; none is missed, and each pair is checked on the
    sets themselves before it links anything. The first candidates are the pairs
    whose SimHashes are equal or pass the pigeonring filter within ``MAX_BITS``
    bits: they find most near copies. SimHash alone cannot find all at such a
    similarity, so the rest follow exactly, the first stars along with them: pairs that share no shingle of their
    prefixes (``_prefixes``) cannot be similar; of the others, first those with
    one node under each shingle are compared, in ``STARS`` rounds with other
    nodes, so that groups of near copies become few components; then every pair
    under a shingle that is not yet in one component, in blocks. Candidates whose
    odd sketches differ too much go before their texts are moved, those of the
    blocks before they are rows.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    prints = cut(
        fingerprints(docs, "node", "text", words).select(F.col("fp0").alias("fp"), F.col("doc_id").alias("node")).distinct()
    )
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("node")))
    same = prints.join(first.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    hashed = same.union(fingerprint_links(first, MAX_BITS))
    hashed = cut(hashed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def tokens(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                found = [shingles(text, words) for text in batch.column(1).slice(low, _SLICE).to_pylist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    some = docs.where(F.pmod("node", F.lit(PART)) == 0)
    listed = (
        some.mapInArrow(tokens, "token long").groupBy("token").count().where("count > 1")
        .orderBy(F.desc("count"), "token").limit(COMMON).collect()
    )
    common = np.array([r["token"] for r in listed], dtype=np.int64).view(np.uint64)
    order = np.argsort(common)
    rank = np.array([r["count"] for r in listed], dtype=np.int64)[order]
    rows = docs.mapInArrow(_prefixes(words, least, common[order], rank), "token long, node long, size int, at int")
    met = stored(
        rows.repartition(parts, "token").sortWithinPartitions("token", "node")
        .mapInArrow(_met, "token long, node long, size int, at int"),
        "prefixes",
    )
    known = stored(sketches(docs, words), "sketches")
    del rows, prints, first, same
    released(docs.sparkSession)
    links = tried = groups = None
    for turn in range(STARS + 1):
        now = met.withColumn("component", F.col("node"))
        if groups is not None:
            now = met.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < STARS:
            sort = ["token", F.xxhash64("node", F.lit(turn)), "node"]
            pairs = (
                now.select("token", "node", "size", "at", "component").repartition(parts, "token")
                .sortWithinPartitions(*sort).mapInArrow(_stars(least), "a long, b long")
            )
        else:
            still = (
                now.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
                .where("x <> y").select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
            )
            key = ["token", "block_a", "block_b"]
            pairs = (
                now.join(still, "token").join(known.select("node", "brief"), "node")
                .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select(
                    "token", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"),
                    "own", "node", "size", "at", "component", "brief",
                )
                .repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_cross(least), "a long, b long")
            )
        pairs = pairs.distinct()
        # The first turn's pairs are SimHash's and the first stars', checked together.
        pairs = cut(pairs.union(hashed).distinct() if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        near = cut(_maybe_similar(pairs, known, least))
        with _batches_of(docs.sparkSession, _SLICE):
            found = cut(_similar(near, docs, words, least))
        tried, links = (pairs, found) if links is None else (tried.union(pairs), links.union(found))
        groups = stored(connected_components(links), "groups")
        del now, pairs, near, found
        released(docs.sparkSession)
    return groups


def _named(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def _free(taken: list[str], name: str) -> str:
    """A name like ``name`` that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def row_hash(docs: DataFrame):
    """A 128-bit hash of a row's columns, of any kind and with any names, as text; which of them are null counts too."""
    return F.md5(F.to_json(F.struct(*(_named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))))


def _text_names(docs: DataFrame, text_col: str):
    """The 64-bit name of each text, as a column of ``docs``. Texts that share one, told apart by another 64 bits, are
    named anew, so that unlike texts are not one."""
    text = F.coalesce(_named(text_col), F.lit(""))
    name, mark = F.xxhash64(text), F.xxhash64(F.lit(1), text)  # the second one is seeded by the hash of 1
    marks = docs.select(name.alias("node"), mark.alias("mark")).groupBy("node").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    shared = [r["node"] for r in marks.where("first <> last").select("node").limit(SHARED_NAMES + 1).collect()]
    if not shared:
        return name
    if len(shared) > SHARED_NAMES:
        raise ValueError("too many texts share a 64-bit name")
    return F.when(name.isin(shared), F.xxhash64(F.lit(2), text)).otherwise(name)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, min_similarity: float = 0.8
) -> DataFrame:
    """``(row, doc_id, component_id, group)``: one row per row of ``docs``.

    Groups are components of all pairs of texts whose shingle sets have at
    least that Jaccard similarity. ``component_id`` is a group's smallest id
    (null if it has none), ``group`` its own name, and ``row`` is ``row_hash``.
    """
    rows = docs.select(
        row_hash(docs).alias("row"), _named(id_col).alias("doc_id"), _text_names(docs, text_col).alias("node"), _named(text_col).alias("text")
    )
    with _batches_of(docs.sparkSession, _ROWS):
        components = similar_components(rows.select("node", "text"), words, min_similarity)
    named = stored(
        rows.drop("text").join(components, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("group")), "named"
    )
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "group").select("row", "doc_id", "component_id", "group")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_bits: int = 4,
    segments: int | None = None,
    families: int = 1,
    min_similarity: float | None = None,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per row of ``docs``.

    ``families`` over 1 links texts that any of so many independent SimHashes
    puts within ``max_bits``. With ``min_similarity`` the links are instead all
    pairs whose shingle sets have at least that Jaccard similarity, within
    ``max_bits`` or not (``similar_groups``, whose ``row`` and ``group`` are
    columns too). ``fingerprint`` is the first family's, as 16 hex digits.
    """
    if min_similarity is not None:
        groups = similar_groups(docs, id_col, text_col, words, min_similarity)
        marked = docs.select(row_hash(docs).alias("row"), docs[text_col].alias("text"))
        prints = fingerprints(marked, "row", "text", words).select(F.col("doc_id").alias("row"), "fp0").distinct()
        return groups.join(prints, "row").select(
            "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id", "row", "group"
        )
    prints = cut(fingerprints(docs, id_col, text_col, words, families))
    names = [f"fp{f}" for f in range(families)]
    # Rows equal in every family are one node, named by its smallest id.
    nodes = cut(prints.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").cast("long").alias("node")))
    links = None
    for name in names:
        first = nodes.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("node"))
        found = fingerprint_links(first, max_bits, segments)
        if families > 1:  # nodes that share this family's fingerprint only
            found = found.union(
                nodes.join(first.select(F.col("fp").alias(name), F.col("node").alias("b")), name)
                .where("node <> b")
                .select(F.col("node").alias("a"), "b")
            )
        links = found if links is None else links.union(found)
    groups = connected_components(links)
    labelled = nodes.join(groups, "node", "left").select(
        *names, F.coalesce("component", "node").alias("component_id")
    )
    # Fingerprints are never null, so every row with an id finds its node; skewed ones are split by AQE.
    joined = prints.join(labelled, names, "left")
    return joined.select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _one_of_each(rows: DataFrame, name: str) -> DataFrame:
    """One of the rows of each ``name``, which are equal, without it; grouped as structs, since maps can't be compared."""
    columns = [c for c in rows.columns if c != name]
    whole = F.struct(*(_named(c).alias(f"c{i}") for i, c in enumerate(columns)))
    one = rows.groupBy(name).agg(F.any_value(whole).alias("whole"))
    return one.select(*(F.col(f"whole.c{i}").alias(c) for i, c in enumerate(columns)))


def keep_one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each group of ``similar_groups``, with all its columns.

    It is the one with the smallest id (a null id comes last; of equal ids the
    smallest row hash), so every group keeps one row, whether or not its
    documents have ids and whether or not their ids repeat elsewhere.
    """
    rows = groups.groupBy("group", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stays = F.col("row") == F.col("first.row")
    others = stored(rows.join(first, "group").where(~stays | (F.col("n") > 1)).select(F.col("row").alias("__row"), stays.alias("__stays")), "others")
    others = F.broadcast(others) if others.count() <= LISTED_NODES else others
    # Documents that stay and are there once move nowhere, if the list of the others is short.
    name = _free(docs.columns, "row")
    marked, listed = docs.withColumn(name, row_hash(docs)), others.withColumnRenamed("__row", name)
    again = _one_of_each(marked.join(listed.where("__stays").select(name), name, "left_semi"), name)
    return marked.join(listed.select(name), name, "left_anti").select(*map(_named, docs.columns)).union(again)
