"""Quality rules: repetition coverage of a text.

Words are hashed from the UTF-8 bytes with a polynomial prefix hash, and n-gram
hashes roll forward one word at a time, all in numpy. For each n-gram length the
operator measures which share of a text's word characters lies inside n-grams
found twice or more (the first one included), and which share of its characters
lies in lines that repeat an earlier line. Five-word windows, which the base
rule counts, are compared word by word after hashing, so a hash collision
cannot change the count.

Defined results: a null text counts as an empty one (no words, all counts 0,
rejected by the base rule); ids may repeat or be null (each row is measured by
itself); other columns are neither read nor returned by ``quality_rules`` and
pass through ``keep_good`` untouched, whatever their names. Texts are read
whole, one at a time, so memory follows the longest text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import word_hashes

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 256

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_gram_share double, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """Largest accepted shares of characters; the longer an n-gram, the less of it may repeat."""

    grams: dict[int, float] = field(
        default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    )
    lines: float = 0.30
    min_words: int = 10
    repeat_percent: int = 20


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """True where a hash is found twice or more."""
    order = np.argsort(hashes, kind="stable")
    near = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][near]] = True
    twice[order[:-1][near]] = True
    return twice


def _covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside windows of n words that begin where ``starts`` is true."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(starts), 1)
    np.add.at(edge, np.flatnonzero(starts) + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, limits: Limits) -> tuple:
    """The columns of ``SCHEMA`` for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    n_words = len(start)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    word_len = chars[end] - chars[start]
    word_chars = int(word_len.sum())
    n_symbols = sum(map(raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))

    n_dup_lines = dup_line_chars = 0
    if b"\n" in raw:
        seen = set()
        for line in raw.split(b"\n"):
            if not line.strip(BLANKS):
                continue
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(line.decode("utf-8", "surrogatepass"))
            seen.add(line)

    n_repeat, worst, over = 0, 0.0, False
    if n_words >= WINDOW:
        words = word_hashes(data, start, end)
        gram = words
        for n in range(2, max([WINDOW, *limits.grams]) + 1):
            if n > n_words:
                break
            gram = gram[:-1] * _GRAM + words[n - 1 :]  # rolls on by one word
            if n < WINDOW and n not in limits.grams:
                continue
            twice = _repeated(gram)
            if n == WINDOW and twice.any():
                spot = np.flatnonzero(twice).tolist()
                tokens = raw.split()
                found = [tuple(tokens[i : i + n]) for i in spot]
                times = Counter(found)
                twice[[i for i, w in zip(spot, found, strict=True) if times[w] < 2]] = False
            inside = _covered(twice, n, n_words)
            if n == WINDOW:
                n_repeat = int(inside.sum())
            if n in limits.grams:
                share = int(word_len[inside].sum()) / word_chars
                worst, over = max(worst, share), over or share > limits.grams[n]
            if n >= WINDOW and not inside.any():
                break  # no longer n-gram repeats either
    line_share = dup_line_chars / max(1, int(chars[-1]))
    base_failed = n_words < limits.min_words or 100 * n_repeat > limits.repeat_percent * n_words
    kept = not (base_failed or over or line_share > limits.lines)
    return (
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat,
        line_share, worst, base_failed, kept,
    )


def _texts(column):
    for low in range(0, len(column), _SLICE):
        yield from column.slice(low, _SLICE).to_pylist()


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None
) -> DataFrame:
    """One row per document: its id and the columns of ``SCHEMA``. No shuffle."""
    limits = limits or Limits()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [measure(t, limits) for t in _texts(batch.column(1))]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.float64() if n.endswith("share") else pa.int64() for n in names[:-2]]
            arrays = [pa.array(c, k) for c, k in zip(cols, [*kinds, pa.bool_(), pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The documents that the rules accept, with all their columns."""
    limits = limits or Limits()
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept = [measure(t, limits)[-1] for t in _texts(batch.column(at))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
