"""SentencePiece encoding and decoding over one table of distinct chunks.

In the models this serves no piece has a whitespace marker after another
character, so merges never cross from one marked word into the next: a text's
ids are its chunks' ids, one after another. A chunk is a run of markers and the
characters up to the next one.

Method. Tasks cut their documents into batches; a batch becomes its distinct
chunks and, for every document, the places of its chunks among them. The chunks
go to the table's ``BUCKETS`` by their hash, packed, one row per batch and bucket.
A bucket meets in one task, which segments each distinct chunk once and puts ids
in the place of chunks. These go back to their batch, where the documents are put
together by place.

Scale: a batch names a chunk once however often its documents hold it, and a
bucket keeps only its distinct chunks in memory while rows stream by, so the
commonest word costs no more than a row per batch. Both shuffles together move
about as many bytes as the texts have. Rows number batches times ``BUCKETS``, so
they grow with the data; raise ``BUCKETS`` beyond some 100 million distinct chunks.

Requirements on the model, checked on loading: identity normalisation, the dummy
prefix, no removal of extra blanks, and no piece with an inner marker.

Defined results: a null text counts as an empty one and encodes to the end id
alone; blanks, tabs and line breaks are kept as the model keeps them; ids of
documents may repeat or be null; an empty table gives an empty result; other
columns are not read. Decoding gives the text back, except what the library
itself changes (a literal marker becomes a blank).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

MARK = "▁"
BUCKETS = 512
TOKENS = 8_000_000  # chunks of a batch
CHARS = 256_000_000  # characters of its texts
LEVEL = 9  # of compression: what is shuffled is several times the distinct chunks
_SLICE = 256
_CHUNK = re.compile(" *[^ ]+| +")


class Segmenter:
    """The model, applied to chunks."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.end_id = self.model.eos_id()
        inner = re.compile(f"[^{MARK}]{MARK}")
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(inner.search(p) for p in pieces) or self.model.encode("a  b ", out_type=str)[:1] != [f"{MARK}a"]:
            raise ValueError("this model's pieces cross whitespace markers")
        if self.model.decode(self.model.encode("a  b ")) != "a  b ":
            raise ValueError("this model does not keep blanks")
        # A text's last blank is a chunk of one marker, which the library cannot be given alone.
        self.lone = [self.model.piece_to_id(MARK)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk."""
        return [i if c else self.lone for c, i in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True)]


def chunks_of(text: str) -> list[str]:
    """The text's chunks without the first marker of each (the library puts that one back)."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


class Batch:
    """Documents as the places of their chunks in a list of distinct ones."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.places: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.ids: list = []
        self.tokens = self.chars = 0

    def add(self, doc_id, text: str | None) -> None:
        place, chunks = self.place, chunks_of(text or "")
        at = np.fromiter((place.setdefault(c, len(place)) for c in chunks), dtype=np.uint32, count=len(chunks))
        self.chars += len(text or "")
        self.tokens += len(chunks)
        self.places.append(at)
        self.sizes.append(len(chunks))
        self.ids.append(doc_id)


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def _joined(chunks: list[str]) -> bytes:
    """Texts without markers as one."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(MARK.join(chunks).encode("utf-8", "surrogatepass"))


def _parted(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass").split(MARK)


_ROW = "bucket int, batch long, low int, chunks binary, ids binary, sizes binary"


def _lead(id_type: pa.DataType) -> list[tuple[str, pa.DataType]]:
    """What a batch's own row has, which needs no table."""
    return [("places", pa.binary()), ("order", pa.binary()), ("docs", pa.list_(id_type)), ("many", pa.list_(pa.int32()))]


def _split(id_type: pa.DataType):
    """Documents to rows by bucket: a batch's chunks, ordered by bucket, from place ``low`` on; and its lead row."""

    def rows(batch: Batch, number: int) -> pa.RecordBatch:
        name = TaskContext.get().partitionId() << 32 | number
        chunks = list(batch.place)
        bucket = np.fromiter(
            (xxhash.xxh32_intdigest(c.encode("utf-8", "surrogatepass")) % BUCKETS for c in chunks), dtype=np.int64, count=len(chunks)
        )
        order = np.array(sorted(range(len(chunks)), key=lambda i: (bucket[i], chunks[i])), dtype=np.int64)
        places = np.concatenate([np.zeros(0, np.uint32), *batch.places])
        # Common chunks get small places, which pack better.
        often = np.argsort(-np.bincount(places, minlength=len(chunks)), kind="stable")
        rank = np.empty(len(chunks), dtype=np.uint32)
        rank[often] = np.arange(len(chunks))
        found, begin = np.unique(bucket[order], return_index=True)
        spans = list(zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(chunks)], strict=True)) if len(found) else []
        out = [(b, name, low, _joined([chunks[i] for i in order[low:high].tolist()]), None, None) for b, low, high in spans]
        out.append(((TaskContext.get().partitionId() + 31 * number) % BUCKETS, name, -1, None, None, None))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        own = [_packed(rank[places]), _packed(rank[order]), batch.ids, batch.sizes]
        arrays += [pa.array([*[None] * len(spans), v], k) for v, (_, k) in zip(own, _lead(id_type), strict=True)]
        names = [c.split()[0] for c in _ROW.split(", ")]
        return pa.RecordBatch.from_arrays(arrays, [*names, *(n for n, _ in _lead(id_type))])

    def run(batches):
        number, held = 0, Batch()
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                part = batch.slice(low, _SLICE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.add(doc_id, text)
                    if held.tokens >= TOKENS or held.chars >= CHARS:
                        yield rows(held, number)
                        number, held = number + 1, Batch()
        if held.ids:
            yield rows(held, number)

    return run


def _segmented(model_file: str):
    """Rows sorted by bucket, with ids in the place of their chunks."""

    def run(batches):
        model, bucket, known = None, None, {}
        for batch in batches:
            rows = batch.select(["bucket", "chunks"]).to_pylist()
            ids, sizes = [], []
            for row in rows:
                if row["chunks"] is None:
                    ids.append(None), sizes.append(None)
                    continue
                model = model or Segmenter(model_file)
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                chunks = _parted(row["chunks"])
                new = [c for c in chunks if c not in known]
                if new:
                    known.update(zip(new, model.segment(new), strict=True))
                found = [known[c] for c in chunks]
                ids.append(_packed(np.array([i for x in found for i in x], dtype=np.uint32)))
                sizes.append(_packed(np.array([len(x) for x in found], dtype=np.uint32)))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {n: pa.array(v, pa.binary()) for n, v in (("chunks", [None] * len(rows)), ("ids", ids), ("sizes", sizes))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def put_together(places, many, order, ids, sizes, model: Segmenter, digests: bool):
    """(token counts, ids or their digests, texts or their digests) of a batch's documents.

    ``many`` are the chunks of each document, ``ids`` those of all distinct
    chunks, one after another, ``sizes`` how many ids each chunk has, and
    ``order`` the chunks' places.
    """
    begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    flat = ids.tolist()
    listed = [flat[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    del flat
    texts: list = [None] * len(listed)
    decimal: list = [None] * len(listed)
    for at, own, text in zip(order.tolist(), listed, model.model.decode(listed, num_threads=1) if listed else [], strict=True):
        texts[at], decimal[at] = text, " ".join(map(str, own)) if digests else own
    del listed
    n_ids = np.empty(len(sizes), dtype=np.int64)
    n_ids[order] = sizes
    edge = np.concatenate(([0], np.cumsum(many))).astype(np.int64)
    counts, first, second = [], [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = places[a:b].tolist()
        counts.append(int(n_ids[places[a:b]].sum()) + 1)
        text = " ".join([texts[i] for i in own])
        if digests:
            first.append(_sha(" ".join([*filter(None, map(decimal.__getitem__, own)), str(model.end_id)])))
            second.append(_sha(text))
        else:
            first.append([*(x for i in own for x in decimal[i]), model.end_id])
            second.append(text)
    return counts, first, second


def encode(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``, or with ``digests`` the SHA-256 of both in hex.

    The model file is named by its path on every machine; it is read once per task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    Segmenter(model_file)  # an unfit model fails here
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    types = [id_type, pa.int64(), *([pa.string()] if digests else [pa.list_(pa.int32())]), pa.string()]
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    row = f"{_ROW}, places binary, order binary, docs array<{kind.simpleString()}>, many array<int>"
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    table = (
        picked.mapInArrow(_split(id_type), row).repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_segmented(model_file), row)
    )

    def together(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["low"])
        lead, chunks = rows[0], rows[1:]  # the lead's place is -1
        del found, rows
        cat = lambda name: np.concatenate([np.zeros(0, np.uint32), *(_unpacked(r.pop(name), np.uint32) for r in chunks)])
        ids, sizes = cat("ids"), cat("sizes")
        places, order = _unpacked(lead["places"], np.uint32), _unpacked(lead["order"], np.uint32)
        made = put_together(places, lead["many"], order, ids, sizes, Segmenter(model_file), digests)
        return pa.table([pa.array(c, t) for c, t in zip([lead["docs"], *made], types, strict=True)], names)

    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return table.groupBy("batch").applyInArrow(together, f"doc_id {kind.simpleString()}, n_tokens long, {last}")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from arrays of ids; a null array decodes to an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                part = batch.slice(low, _SLICE)
                texts = [model.decode(i) if i else "" for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return picked.mapInArrow(run, f"doc_id {kind}, text string")
