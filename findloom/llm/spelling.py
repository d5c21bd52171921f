"""Spelling variants of a corpus' words, by full neighbourhood generation.

Words are counted inside the tasks that read them and only counts are shuffled.
Every word of the vocabulary then emits each text that is one deletion,
replacement or insertion away, over the letters that the vocabulary has, each
once; those that are words themselves are found by an equality join, so no
distance is ever computed. A word has at most as many neighbours as it emits
texts, so no key of that join, nor of what follows, is hot.

The vocabulary is broadcast while its rows and bytes are within bounds, else
the emitted texts are dealt out and joined with it where they meet.

Defined results: a null or empty text has no words; texts of any length are
read in pieces cut between words; repeated ids and rows count as often as they
are there; a null id is an empty one where the id matters; other columns are
not read, whatever their names; an empty table gives an empty result; of
neighbours that are equally common the first in code-point order wins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

LETTERS = "A-Za-zÀ-ÿ"
PIECE = 1 << 20  # characters of a text that are read at once
TOGETHER = 300_000  # words that a task counts before it hands them on
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 32 << 20
WORDS_PER_TASK = 20_000
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def _pieces(text: str, gap: re.Pattern) -> Iterator[str]:
    """A text cut where no word is."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = gap.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _misspelt(run: str, base: int, one_in: int) -> str:
    """``run``, without one letter if the checksum of its document and itself says so."""
    mark = zlib.crc32(run.encode(), base)
    if mark % one_in:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5,
    typo_one_in: int | None = None,
) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z in lower case, of ``min_chars`` or more, found ``min_count`` times or more.

    With ``typo_one_in`` the runs whose checksum with the document's id is
    divisible by it lose a letter before they are counted.
    """
    runs, gap = re.compile(f"[{LETTERS}]{{{min_chars},}}"), re.compile(f"[^{LETTERS}]")

    def run(batches):
        counts: dict[str, int] = {}

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                base = zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
                for piece in _pieces(text, gap):
                    own = Counter(w if w.islower() else w.translate(_LOWER) for w in runs.findall(piece))
                    for word, n in own.items():
                        if typo_one_in:
                            word = _misspelt(word, base, typo_one_in)
                            if len(word) < min_chars:
                                continue
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > TOGETHER:
                    yield handed()
                    counts.clear()
        yield handed()

    picked = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    found = picked.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def neighbourhoods(words: DataFrame, letters: list[str]) -> DataFrame:
    """``words(word)`` to ``(word, text)``: every text one letter away, each once.

    Of letters in a row that are equal the first is deleted; a letter is not
    inserted before its like, which gives the same text as behind it.
    """
    letter = F.explode(F.array(*map(F.lit, letters)))
    spot = F.transform(
        F.sequence(F.lit(0), F.char_length("word")),
        lambda i: F.struct(
            F.left("word", i).alias("head"), F.substring("word", i, F.lit(1)).alias("before"),
            F.substring("word", i + 1, F.lit(1)).alias("here"), F.substring("word", i + 1, F.char_length("word")).alias("tail"),
            F.substring("word", i + 2, F.char_length("word")).alias("rest"), (i == 0).alias("first"),
        ),
    )
    spots = words.select("word", F.inline(spot))
    inside = spots.where("here <> ''")
    deleted = inside.where("first or here <> before").select("word", F.concat("head", "rest").alias("text"))
    replaced = inside.select("word", "head", "here", "rest", letter.alias("letter")).where("letter <> here")
    inserted = spots.select("word", "head", "here", "tail", letter.alias("letter")).where("letter <> here")
    return deleted.union(replaced.select("word", F.concat("head", "letter", "rest"))).union(
        inserted.select("word", F.concat("head", "letter", "tail"))
    )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary(word, n)``, a row per word, to ``(word, near, near_n)``: all pairs of words one letter apart, both ways."""
    size = vocabulary.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    letter = F.explode(F.split("word", ""))
    letters = sorted(r["letter"] for r in vocabulary.select(letter.alias("letter")).where("letter <> ''").distinct().collect())
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    if size["rows"] <= BROADCAST_WORDS and size["bytes"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    parts = max(vocabulary.sparkSession.sparkContext.defaultParallelism, math.ceil(size["rows"] / WORDS_PER_TASK))
    texts = neighbourhoods(vocabulary.select("word").repartition(parts, "word"), letters or [""])
    return texts.join(known, texts["text"] == known["near"]).select("word", "near", "near_n")


def _ends(forms: DataFrame, times: int) -> DataFrame:
    """``forms(word, form)`` to ``(word, root)``, each form followed ``2 ** times`` steps at most."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(times):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def spelling_groups(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """``vocabulary(word, n)`` to ``(word, form, root, n, n_near, form_n)``.

    A word's form is the commonest word one letter away, if that is at least
    ``ratio`` times as common. Counts rise by that factor with every step from
    form to form, so the number of steps, and of joins that double them, follows
    from the largest count. ``vocabulary`` is read several times: store it.
    """
    near = near_words(vocabulary)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(F.negative("near_n").alias("less"), "near")).alias("best"))
    form_n = F.negative("best.less")
    is_form = form_n >= F.lit(ratio) * F.col("n")
    known = stored(
        vocabulary.join(best, "word", "left").select(
            "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, form_n).alias("form_n"),
        ), "forms",
    )
    span = known.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = math.log(max(span["most"] or 1, 1) / max(span["least"] or 1, 1), ratio) + 1
    ends = _ends(known.where("form is not null"), math.ceil(math.log2(max(steps, 1))))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_roots(texts: DataFrame, column: str, groups: DataFrame, into: str = "root") -> DataFrame:
    """``texts`` with the root of the word in ``column``; words without a form keep themselves."""
    known = groups.where("form is not null").select(F.col("word").alias("__word"), F.col("root").alias("__root"))
    return texts.join(known, texts[column] == known["__word"], "left").withColumn(into, F.coalesce("__root", texts[column])).drop("__word", "__root")
