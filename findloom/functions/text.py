"""Text as Spark expressions: folding, words, index terms, spelling variants."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

WORD = r"[\p{L}\p{M}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


@cache
def _marked_letters() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and those letters."""
    marked, plain = [], []
    for point in range(0x80, 0x10000):
        if 0xAC00 <= point < 0xD7A4 or 0xD800 <= point < 0xE000:
            continue  # syllables that fall apart into several letters; surrogates
        letter = chr(point)
        parts = [c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != letter:
            marked.append(letter)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents, special letters spelled out. Plain ASCII, found by its length, only needs the case."""
    out = F.lower(text)
    for special, plain in lx.SPECIAL:
        out = F.replace(out, F.lit(special), F.lit(plain))
    whole = F.regexp_replace(F.translate(out, *_marked_letters()), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(whole)


def normalize(text: Column) -> Column:
    """Folded words joined by single blanks."""
    return F.trim(F.regexp_replace(fold(text), NOT_WORD, " "))


def tokens(text: Column) -> Column:
    """The folded words, stopwords included."""
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def words(text: Column) -> Column:
    """The words as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def folded_words(text: Column) -> Column:
    """The fold of every word. A text of plain ASCII is folded before it is cut, and its words are found by their letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).otherwise(F.transform(words(text), fold))


def both_forms(text: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    """The terms of a German text: every word's fold, if it is indexable, and what ``forms`` adds for its umlauts."""
    norms = F.transform(words(text), lambda w: F.struct(w.alias("raw"), fold(w).alias("norm")))
    kept = F.filter(norms, lambda w: indexable(w["norm"], F.lit("de"), stopwords))

    def both(w: Column) -> Column:
        extra = F.filter(F.array(german(w["raw"])), lambda s: (s != w["norm"]) & (F.octet_length(s) <= lx.MAX_TERM_BYTES))
        return F.when(w["raw"].rlike("[äöüÄÖÜ]"), F.concat(F.array(w["norm"]), extra)).otherwise(F.array(w["norm"]))

    return F.flatten(F.transform(kept, both))


def folded_list(listed: list[str]) -> list[str]:
    """A word list folded in Python, for literals."""
    out = []
    for word in listed:
        word = word.lower()
        for special, plain in lx.SPECIAL:
            word = word.replace(special, plain)
        out.append("".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn"))
    return list(dict.fromkeys(out))


def is_stopword(term: Column, lang: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    stopwords = lx.STOPWORDS if stopwords is None else stopwords
    found = F.lit(False)
    for code, listed in stopwords.items():
        if listed:
            found = found | ((lang == code) & term.isin(folded_list(listed)))
    return found


def indexable(term: Column, lang: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    """Two characters or more, 64 bytes or fewer, no stopword of the language."""
    return (
        (F.char_length(term) >= lx.MIN_TERM_CHARS)
        & (F.octet_length(term) <= lx.MAX_TERM_BYTES)
        & ~is_stopword(term, lang, stopwords)
    )


def german(word: Column) -> Column:
    """The word's fold with ae, oe and ue for its umlauts."""
    out = F.lower(word)
    for umlaut, pair in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        out = F.replace(out, F.lit(umlaut), F.lit(pair))
    return fold(out)


def forms(word: Column, lang: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    """The terms a word is indexed under: none, its fold, or in German also the spelled-out umlauts."""
    norm = fold(word)
    second = german(word)
    extra = F.when(
        (lang == "de") & (second != norm) & (F.octet_length(second) <= lx.MAX_TERM_BYTES), F.array(second)
    ).otherwise(F.array().cast("array<string>"))
    return F.when(indexable(norm, lang, stopwords), F.concat(F.array(norm), extra)).otherwise(
        F.array().cast("array<string>")
    )


def singulars(term: Column, lang: Column) -> Column:
    """Safe singulars of a folded word."""
    size = F.char_length(term)
    less = lambda n: F.left(term, size - n)
    plain = F.when(lang.isin("fr", "en") & (size >= 5) & term.rlike("[sx]$"), less(1))
    ies = F.when((lang == "en") & (size >= 6) & term.endswith("ies"), F.concat(less(3), F.lit("y")))
    de = F.when(
        lang == "de",
        F.when((size >= 6) & term.endswith("en"), less(2)).when((size >= 5) & term.rlike("[ens]$"), less(1)),
    )
    return F.array_compact(F.array(plain, ies, de))


def without_stopwords(tokens_: Column, lang: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    return F.array_join(F.filter(tokens_, lambda t: indexable(t, lang, stopwords)), " ")


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment in normalized text."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def grams(normalized: Column, longest: int) -> Column:
    """Every run of one to ``longest`` words of normalized text, each once: what ``has_phrase`` finds in it."""
    found = F.filter(F.split(normalized, " "), lambda w: w != "")
    n = F.size(found)
    runs = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), n)),
        lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(found, i, k), " ")),
    )
    return F.when(n > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def quoted(query: Column) -> Column:
    """Quoted phrases of two words or more, normalized and distinct, in the order of the query."""
    pattern = r'"[^"]+"|“[^”]+”|«[^»]+»|„[^“”]+[“”]'
    found = F.transform(F.regexp_extract_all(query, F.lit(pattern), 0), normalize)
    return F.array_distinct(F.filter(found, lambda p: F.contains(p, F.lit(" "))))


def clean(query: Column) -> Column:
    """A decoded query as typed: tags out, blanks collapsed, at most 200 characters."""
    plain = F.regexp_replace(F.coalesce(query, F.lit("")), "<[^>]*>", "")
    return F.trim(F.left(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), F.lit(lx.MAX_QUERY_CHARS)))


def parts(text: Column) -> Column:
    """The text cut into words and what lies between them, in turn; joined again they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{WORD}|{NOT_WORD}"), 0)


def synonym_rows(
    sets: dict[str, list[list[str]]] | None = None, one_way: dict[str, dict[str, list[str]]] | None = None
) -> list[tuple[str, str, str]]:
    """(lang, word, synonym), all folded."""
    sets = lx.SYNONYM_SETS if sets is None else sets
    one_way = lx.SYNONYMS_ONE_WAY if one_way is None else one_way
    rows: dict[tuple[str, str, str], None] = {}
    for lang, groups in sets.items():
        for group in groups:
            group = folded_list(group)
            rows.update(((lang, a, b), None) for a in group for b in group if a != b)
    for lang, pairs in one_way.items():
        for word, others in pairs.items():
            rows.update(((lang, folded_list([word])[0], b), None) for b in folded_list(others))
    return list(rows)
