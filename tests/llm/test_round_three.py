"""Decontamination, vector codes and spelling variants against plain versions, their SQL and odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findloom.llm import codes, decontaminate, oracle, queries, spelling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for table, (names, rows) in tables.items():
        con.execute(f"create table {table} ({names})")
        if rows:
            con.executemany(f"insert into {table} values ({', '.join('?' * len(names.split(',')))})", rows)
    con.execute(sql)
    found = [c[0] for c in con.description]
    return sorted((tuple(sorted(zip(found, r, strict=True))) for r in con.fetchall()), key=repr)


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


# --- decontamination ---------------------------------------------------------

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
DOCS = [
    (1, f"before {PASSAGE} after"), (2, f"before {PASSAGE.upper().replace(' ', ' -- ')}; after"), (3, None), (4, ""),
    (5, " \n\t"), (6, " ".join(PASSAGE.split()[:9])), (7, "short one"), (7, "a short, one!"), (None, f"{PASSAGE} {PASSAGE}"),
    (8, "x " * 900 + PASSAGE + " y" * 900), (9, "漢字 ÉÉ éé one"), (1, f"before {PASSAGE} after"), (10, "0:1;2[a]z`{q}"),
]
ITEMS = [
    (5, PASSAGE), (11, PASSAGE), (11, f"{PASSAGE} xi"), (2, "Short one"), (3, None), (4, "--"), (None, "漢字 éé"), (6, "éé one"),
    (7, "beta " + PASSAGE), (8, "z q"), (100, "kappa lambda mu nu after"),
]


def decontaminated(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("spans", "items", "n_words", "a.b")})
    found = decontaminate.find_windows(docs, spark.createDataFrame(items, "item_id long, text string"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@pytest.mark.parametrize(("block", "piece"), [(decontaminate.BLOCK_BYTES, decontaminate.PIECE_BYTES), (60, 50)])
def test_odd_documents_give_the_rows_of_the_sql(spark, monkeypatch, block, piece):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 4096 if block > 60 else 2)
    theirs = sql_rows(oracle.BENCHMARK, documents=("doc_id bigint, text varchar", DOCS), benchmark=("item_id bigint, text varchar", ITEMS))
    assert rows_of(decontaminated(spark, DOCS, ITEMS)) == theirs
    assert sum(dict(r)["contaminated"] for r in theirs) >= 7


def test_empty_tables_of_documents_and_items(spark):
    assert decontaminated(spark, [], ITEMS).collect() == []
    assert all(r["n_hit"] == 0 and r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in decontaminated(spark, DOCS, []).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=30))
def test_windows_equal_plain_ones(items, words):
    found = decontaminate.Windows([(str(i), " ".join(item).encode()) for i, item in enumerate(items) if item], 3)
    codes_ = np.array([found.numbers.get(w.encode(), 0) for w in words], dtype=np.int32)
    hit, names = set(), set()
    for i, item in enumerate(items):
        size = min(len(item), 3)
        for at in range(len(item) - size + 1 if size else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == item[at : at + size]:
                    hit.update(range(k, k + size))
                    names.add(str(i))
    spans, owners = found.find(codes_)
    joined = decontaminate._joined(spans)
    assert {w for s in joined for w in range(s["start"], s["end"])} == hit and set(owners) == names
    assert all(a["end"] < b["start"] for a, b in zip(joined, joined[1:], strict=False))


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashes", lambda columns: np.zeros(len(columns[0]), dtype=np.uint64))
    found = decontaminate.Windows([("1", b"a b c"), ("2", b"b c d"), ("3", b"a b c"), ("4", b"x y")], 3)
    numbers = np.array([found.numbers.get(w, 0) for w in b"q a b c d x".split()], dtype=np.int32)
    spans, owners = found.find(numbers)
    assert owners == ["1", "2", "3"] and decontaminate._joined(spans) == [{"start": 1, "end": 5}]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_spans_and_documents_are_removed(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = [
        (1, f"Well before it: {PASSAGE.title()}. And a good deal more after it, éà, than before it, so it stays", "s1"), (2, PASSAGE, "s2"),
        (3, None, "s3"), (4, "", None), (5, "clean text, untouched", "s5"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("row", F.create_map(F.lit("k"), "doc_id"))
    items = spark.createDataFrame([(1, PASSAGE), (2, "one more item that is nowhere to be found in any of these texts")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.remove(docs, items).collect()}
    assert set(got) == {1, 3, 4, 5} and got[1]["row"] == {"k": 1} and got[1]["spans"] == "s1"
    assert got[1]["text"] == "Well before it: . And a good deal more after it, éà, than before it, so it stays"
    assert (got[3]["text"], got[4]["text"], got[5]["text"]) == (None, "", "clean text, untouched")


# --- vector codes ------------------------------------------------------------


def plain_codes(x, parts, entries, rounds):
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)

    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for k in range(books.shape[1]):
                own = x[found[:, p] == k, p]
                if len(own):
                    books[p, k] = [int(total) // len(own) for total in own.sum(axis=0)]
    return nearest(), books


@pytest.mark.parametrize(("n", "spread", "entries", "rounds"), [(700, 3.0, 64, 2), (400, 0.01, 16, 4), (300, 0.004, 300, 2), (5000, 1.0, 8, 3)])
def test_codes_equal_plain_rounds(spark, n, spread, entries, rounds):
    rng = np.random.default_rng(n)
    x = np.round(rng.standard_normal((n, 8)) * spread, 2)  # coarse, so that distances are often equal
    table = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    coded, books = codes.fit_and_encode(codes.usable(table), parts=4, entries=entries, rounds=rounds)
    want, want_books = plain_codes(np.floor(256 * x).astype(np.int64), 4, entries, rounds)
    assert (books == want_books).all()
    digits = 2 if entries <= 256 else 8
    assert {r["vec_id"]: r["code"] for r in coded.collect()} == {i: "".join(f"{k:0{digits}x}" for k in row) for i, row in enumerate(want)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 30, 100_000]))
def test_stored_bounds_hold_and_prune(seed, most):
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-most, most + 1, (50, 2, 3)), rng.integers(-most, most + 1, (2, 7, 3))
    bounds = codes.Bounds(50, 2, 7)
    for p in range(2):
        assigned = bounds.assigned[:, p].astype(np.int64)
        codes._assign_part(x[:, p], books[p], assigned, bounds.upper[:, p], bounds.lower[:, p])
        bounds.assigned[:, p] = assigned
    after = books + rng.integers(-2, 3, books.shape)
    import pyarrow as pa

    again = codes.Bounds(50, 2, 7)
    again.load([pa.array(c, pa.binary()) for c in bounds.stored()], codes._moved(books, after))
    true = np.sqrt(((x[:, :, None] - after[None]) ** 2).sum(axis=3))
    own = np.take_along_axis(true, again.assigned[:, :, None].astype(np.int64), axis=2)[:, :, 0]
    assert (again.lower <= true).all() and (again.upper >= own).all()
    if most > 1:
        assert (again.lower > 0).mean() > 0.3


def test_odd_vectors_give_the_rows_of_the_sql(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(32).tolist(), i % 2 if i % 5 else None) for i in range(150)]
    odd = [(200, None, 1), (201, [nan] * 32, 1), (202, [inf] + [0.0] * 31, None), (203, [None] + [0.0] * 31, 7), (204, [-0.001] * 32, 7)]
    rows += odd + rows[:40] + [(None, [0.5] * 32, 1), (-3, [1.0] * 32, None), (-3, [-1.0] * 32, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(c) for c in ("code", "error", "vector")})
    coded, books = codes.fit_and_encode(codes.usable(table))
    got = codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))
    assert rows_of(got) == sql_rows(oracle.CODES, embeddings=("vec_id bigint, embedding double[], label integer", rows))


def test_vectors_of_other_lengths_have_no_code(spark):
    rows = [(1, [], 0), (2, [1.0] * 5, 0), (3, [1.0] * 16, 0), (4, [2.0] * 16, 1), (5, [1.0] * 32, 1), (6, [3.0] * 32, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = codes.fit_and_encode(codes.usable(table))
    got = {r["vec_id"]: r for r in codes.with_label_errors(coded).collect()}
    assert {i for i, r in got.items() if r["code"]} == {3, 4} and got[4]["code"] == "01" * 16 and books.shape == (16, 2, 1)
    assert got[6]["label_error"] is None and got[5]["label_error"] == 0
    back = {r["vec_id"]: r["vector"] for r in codes.decode(coded, books).collect()}
    assert back[3] == [1.0] * 16 and back[4] == [2.0] * 16 and back[5] is None
    none, nothing = codes.fit_and_encode(codes.usable(table.where("vec_id < 3")))
    assert nothing is None and [r["code"] for r in none.collect()] == [None, None]
    assert codes.with_label_errors(codes.fit_and_encode(codes.usable(table.where("false")))[0]).collect() == []


def test_components_too_large_for_exact_distances_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e12] * 16, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="cannot be coded exactly"):
        codes.fit_and_encode(codes.usable(table))


# --- spelling variants -------------------------------------------------------


def plain_neighbourhood(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out.update(word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out.update(word[:i] + c + word[i + 1 :] for c in letters)
    return out - {word}


def test_neighbourhoods_hold_each_text_once(spark):
    words = ["aabbab", "bananas", "zzzzzz", "é÷étété", "x"]
    letters = sorted(set("".join(words)))
    found = defaultdict(list)
    for r in spelling.neighbourhoods(spark.createDataFrame([(w,) for w in words], "word string"), letters).collect():
        found[r["word"]].append(r["text"])
    for word in words:
        assert sorted(found[word]) == sorted(plain_neighbourhood(word, letters))


def plain_groups(docs):
    counts = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            mark = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if mark % 199 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted(set("".join(words)))
    near = {w: plain_neighbourhood(w, letters) & words.keys() for w in words}
    best = {w: min(found, key=lambda x: (-words[x], x)) for w, found in near.items() if found}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(rows, key=repr)


SPELLED = [
    (1, "letters " * 700 + "lettars " * 130 + "lettaris " * 26 + "leettaris " * 5), (2, "Letter-s LETTERS lettérs " * 6), (3, None), (4, ""),
    (5, "×÷×÷×÷ " * 5), (None, "nobody's wordings " * 5), (5, "a" * 40_000), (6, ("ÀÉÎÕÜß ÀÉÎÕÜs " * 5)), (6, "abcdefg abcdef abcdefg bcdefg " * 6),
    (7, "漢字lettersŁodz lettersŁ " * 9), (8, "_letter_letter_9letter9 " * 8), (8, "_letter_letter_9letter9 " * 8),
]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_give_plain_groups(spark, monkeypatch, small):
    if small:  # texts in pieces, counts handed on often, and a vocabulary that is not broadcast
        monkeypatch.setattr(spelling, "PIECE", 10)
        monkeypatch.setattr(spelling, "TOGETHER", 3)
        monkeypatch.setattr(spelling, "BROADCAST_WORDS", 0)
    docs = spark.createDataFrame(SPELLED, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("word", "n", "root", "form", "a.b")})
    words = spelling.count_words(docs, typo_one_in=199)
    got = spelling.spelling_groups(words.persist())
    mine = sorted((tuple(r) for r in got.collect()), key=repr)
    assert mine == plain_groups(SPELLED)
    assert ("leettaris", "lettaris", "letters") in {r[:3] for r in mine}
    theirs = sql_rows(oracle.SPELLINGS, documents=("doc_id bigint, text varchar", SPELLED))
    assert rows_of(got) == theirs


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None), (2, "tiny")], "doc_id long, text string")
    for table in (docs, docs.where("false")):
        assert spelling.spelling_groups(spelling.count_words(table)).collect() == []


def test_words_are_replaced_by_their_roots(spark):
    groups = spelling.spelling_groups(spark.createDataFrame([("letters", 100), ("lettars", 9), ("others", 7)], "word string, n long"))
    texts = spark.createDataFrame([("lettars",), ("letters",), ("nothing",), (None,)], "w string")
    assert [r["root"] for r in spelling.with_roots(texts, "w", groups).orderBy("w").collect()] == [None, "letters", "letters", "nothing"]


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_elkan_codes", "op13_spelling_neighbourhoods"])
def test_contract_columns(spark, name):
    want = {
        "op11_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op12_elkan_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op13_spelling_neighbourhoods": ["word", "form", "root", "n", "n_near", "form_n"],
    }
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns == want[name]
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in ("n_words", "n_hit", "n_items", "error", "label_error", "n", "n_near", "form_n") if c in kinds)
