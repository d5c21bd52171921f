"""Quality rules, SimHash, PII, SentencePiece and packing against plain versions and odd tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findloom.llm import components, lm, packing, pieces, pii, quality, sharding, simhash

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"), (2, None, "b"), (3, "", None),
    (4, " \t\n ", "d"), (5, "one two three four five six seven eight nine ten eleven twelve", "a"), (5, "x", "same id"),
    (None, "no id at all", "f"), (7, "word " * 20_000, "long"), (8, "y" * 50_000, "one long word"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns with names that the operators use inside.
    schema = "doc_id long, text string, kept string, fp string, node string, spans string, bucket string, shard string"
    return spark.createDataFrame([(a, b, *[c] * 6) for a, b, c in ODD], schema)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- quality rules -----------------------------------------------------------


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed,
    )


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t#$ \x1c", max_size=120))
def test_measures_equal_plain_ones(text):
    got = quality.measure(text, quality.Limits())
    assert (*got[:5], got[7]) == plain_quality(text)


def test_quality_over_documents(docs):
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        assert (*got[1:6], got["base_failed"]) == plain_quality(r["text"])
        assert not (got["kept"] and got["base_failed"])


def test_quality_of_odd_rows(odd, empty):
    assert quality.quality_rules(odd).count() == len(ODD)
    assert sorted(r["doc_id"] for r in quality.keep_good(odd).collect()) == [1, 1, 5]
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0


# --- SimHash -----------------------------------------------------------------


def plain_fingerprint(text, n=4):
    words = WORD.findall(low(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(prints, near)


@pytest.mark.parametrize("segments", [None, 7, 8, 9])
def test_big_groups_are_cut_into_blocks_without_loss(spark, monkeypatch, segments):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for b in base for _ in range(60)})
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    links = simhash.fingerprint_links(rows, 4, segments)
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if (a ^ b).bit_count() <= 4]
    want = plain_components(range(len(fps)), near)
    assert {i: found.get(i, i) for i in want} == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=7), st.integers(6, 9))
def test_a_pair_passes_the_ring_under_one_key_if_it_is_near(bits, segments):
    diff = np.array([sum(1 << b for b in bits)], dtype=np.uint64)
    keys = set(simhash.key_names(segments, 4).values())
    passed = sum(bool(simhash.ring_filter(diff, np.array([k]), segments, 4)[0]) for k in keys)
    assert passed == (len(bits) <= 4)


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segments_for(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**13)] == [6, 6, 7, 8, 9]


def test_odd_rows_of_simhash(odd, empty):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD) and simhash.simhash_groups(empty).count() == 0
    by_text = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert by_text[2, "0" * 16] == by_text[3, "0" * 16] == by_text[4, "0" * 16] == 2
    assert sum(r["component_id"] == 1 for r in rows) == 3


def test_copies_go_and_one_stays(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, 200)) for _ in range(30)]
    near = [t.split() for t in texts[:10]]
    for words in near:
        words[100] = "changed"
    rows = [(i, t) for i, t in enumerate(texts + [" ".join(w) for w in near] + texts[:5])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    groups = simhash.simhash_groups(table, words=5, families=6, min_similarity=0.8)
    kept = [r["doc_id"] for r in simhash.keep_one_of_each(table, groups).collect()]
    assert sorted(kept) == list(range(30))


def plain_shingles(text, n=5):
    words = WORD.findall(low(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def plain_similar(texts, least=0.8):
    """Components of ids by the Jaccard similarity of all pairs."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    near = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    ]
    return plain_components(sets, near), near


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in (1, 2, 9, 60, 700, 5000):
        for kept in (1.0, 0.95, 0.9, 0.85, 0.6, 0.0):
            for size in (n, n + n // 5, 4 * n):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                y = np.unique(np.concatenate((x[: int(kept * len(x))], own[: max(0, size - int(kept * len(x)))])))
                shared = len(np.intersect1d(x, y))
                similar = shared >= 0.8 * (len(x) + len(y) - shared)
                match = simhash._sketches_may_match(simhash.odd_sketch(x), len(x), simhash.odd_sketch(y), len(y), 0.8)
                assert match or not similar
                ruled_out += not match
    assert ruled_out > 40  # and most others are


def test_every_pair_of_similar_texts_is_linked(spark, docs):
    rng = np.random.default_rng(8)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in range(40):  # pairs from 0.8 up, which no SimHash brings within four bits for sure
        words = [f"v{x}" for x in rng.integers(0, 5000, 40 + 10 * i)]
        other = list(words)
        for at in rng.choice(len(words), len(words) // 50, replace=False):
            other[at] = "changed"
        texts |= {10_000 + 2 * i: " ".join(words), 10_001 + 2 * i: " ".join(other)}
    want, near = plain_similar(texts)
    assert len(near) > 40
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = simhash.simhash_groups(table, words=5, families=6, min_similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == want


def test_big_groups_of_mixed_similarity_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = np.random.default_rng(11)
    template = "alpha beta gamma delta epsilon " * 200  # governs every fingerprint, but is five shingles of each set
    texts = {}
    for i in range(25):
        words = [f"u{x}" for x in rng.integers(0, 9000, 90)]
        for k in range(3):
            words[20 + 30 * k] = "changed"
            texts[len(texts)] = template + " ".join(words)
    for i in range(60):  # windows that move on: the ends of the chain are unlike
        texts[len(texts)] = " ".join(f"c{x}" for x in range(4 * i, 4 * i + 300))
    want, _ = plain_similar(texts)
    assert len(set(want.values())) > 20
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = simhash.simhash_groups(table, words=5, families=6, min_similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == want


def test_one_of_each_group_stays_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    a, b, c, d, e = (" ".join(f"x{x}" for x in rng.integers(0, 9000, 60)) for _ in range(5))
    rows = [
        (None, a, "z"), (None, a, "y"), (None, b, None), (None, b, None), (1, c, "k"), (1, d, "k"), (1, d, "j"), (2, c, None), (3, e, None), (None, e, "n"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = []
    for part in (table, table.repartition(5)):
        groups = simhash.simhash_groups(part, words=5, families=6, min_similarity=0.8)
        found.append(sorted(map(tuple, simhash.keep_one_of_each(part, groups).collect()), key=repr))
    assert found[0] == found[1]
    assert sorted(r[1] for r in found[0]) == sorted([a, b, c, d, e])
    assert {r[1]: r[0] for r in found[0]} == {a: None, b: None, c: 1, d: 1, e: 3}


def test_columns_of_any_name_and_kind_pass_the_near_dedup(spark):
    text = "one two three four five six seven eight nine"
    rows = [(1, text), (2, text), (2, text), (3, "another text of quite other words altogether"), (None, text + " ten"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.concat(F.lit("r"), F.coalesce("doc_id", F.lit(0))).alias("__row"), F.lit("kept").alias("row"), F.create_map(F.lit("k"), "doc_id").alias("group"),
        F.lit("d").alias("a.b"), F.array(F.create_map(F.lit(1), F.lit(2))).alias("c`d"), F.struct("doc_id").alias("node"),
    )
    kept = simhash.keep_one_of_each(docs, simhash.similar_groups(docs, words=5, min_similarity=0.8))
    assert [(f.name, f.dataType.simpleString()) for f in kept.schema] == [(f.name, f.dataType.simpleString()) for f in docs.schema]
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert {(r[0], r[2], r[4]["k"]) for r in got} == {(1, "r1", 1), (3, "r3", 3), (4, "r4", 4)} and len(got) == 3
    assert all(r[3] == "kept" and r[5] == "d" and r[6] == [{1: 2}] and r[7][0] == r[0] for r in got)


def test_texts_that_share_a_name_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i % 3} of three quite different ones {i % 3}") for i in range(6)], "doc_id long, text string")
    real = F.xxhash64

    def clash(*columns):  # every text has one name; a second hash still tells them apart
        return F.lit(7).cast("long") if len(columns) == 1 else real(*columns)

    monkeypatch.setattr(simhash.F, "xxhash64", clash)
    names = docs.select("doc_id", simhash._text_names(docs, "text").alias("name"))
    monkeypatch.undo()
    found = {r["doc_id"]: r["name"] for r in names.collect()}
    assert len(set(found.values())) == 3 and all(found[i] == found[i + 3] for i in range(3))


def test_connected_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(chain).collect()}
    assert set(found.values()) == {0, 900} and len(found) == 303


# --- PII ---------------------------------------------------------------------


def plain_rules(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.1259+ -()é\n", max_size=60))
def test_rules_equal_plain_patterns(text):
    assert pii.rule_spans(text) == plain_rules(text)


def test_rules_over_documents_and_long_runs(docs):
    for r in docs.collect():
        assert pii.rule_spans(r["text"]) == plain_rules(r["text"])
    for text in ("a" * 200_000, "1" * 200_000, "@" * 100_000, "+1" * 50_000, "1." * 60_000):
        pii.rule_spans(text)  # linear, so it ends


def test_repeated_number_gets_the_label_of_its_twin(spark):
    model = pii.Model()
    model.word[pii.FEATURES.index("n7"), 4] = 1.0
    model.skip[4, 4] = 6.0
    graph = pii.Graph(["+33 555 5550123 and later 5550123 x", "5550123"])
    p = model.marginals(graph)
    assert graph.skip and p[graph.doc.index(1)][4] < 0.5 and p[3 if len(p) > 3 else -2][4] > p[graph.doc.index(1)][4]


def test_pii_of_odd_rows(odd, empty, docs):
    model = pii.train(docs)
    rows = pii.pii_spans(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["base"] == "" for r in rows)
    assert pii.redact(odd, model).columns == odd.columns and pii.pii_spans(empty, pii.train(empty)).count() == 0
    for r in pii.pii_spans(docs, model).collect():
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_masked_text_has_no_rule_spans(spark, docs):
    table = spark.createDataFrame([(1, "mail a.b@c.org or +1 (277) 555-9423, ip 10.0.0.1", 0)], "doc_id long, text string, n_chars long")
    row = pii.redact(table, pii.train(docs), length_col="n_chars").first()
    assert row["text"] == "mail <EMAIL> or <PHONE>, ip <IP>" and row["n_chars"] == len(row["text"])


# --- SentencePiece -----------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab  ▁é日😀\n\t.<s>\x00", max_size=40), max_size=5))
def test_chunks_encode_as_the_library_does(texts):
    batch, model = pieces.Batch(), pieces.Segmenter(MODEL)
    for i, text in enumerate(texts):
        batch.add(i, text)
    ids = model.segment(list(batch.place))
    places = np.concatenate([np.zeros(0, np.uint32), *batch.places])
    flat, sizes = np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.uint32)
    found = pieces.put_together(places, batch.sizes, np.arange(len(ids)), flat, sizes, model, False)
    for text, n, got, back in zip(texts, *found, strict=True):
        want = PROCESSOR.encode(text, add_eos=True)
        assert got == want and n == len(want) and back == PROCESSOR.decode(want)


def test_encoding_documents_and_back(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(pieces, "TOKENS", 5_000)  # several batches a task
    encoded = pieces.encode(docs, MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = encoded.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["ids"] == PROCESSOR.encode(texts[r["doc_id"]], add_eos=True) and r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL).collect()} == texts
    assert pieces.encode(empty, MODEL).count() == 0


def test_digests_of_odd_rows(odd):
    rows = pieces.encode(odd, MODEL, digests=True).collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc_id, text, _ in ODD:
        ids = PROCESSOR.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(PROCESSOR.decode(ids))))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


# --- packing -----------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_boundaries_waste_least(histogram, buckets):
    lengths = np.array(sorted(histogram), dtype=float)
    counts = np.array([histogram[int(x)] for x in lengths])

    def waste(ends):
        return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))

    got = packing.best_boundaries(lengths, counts, buckets)
    options = itertools.chain.from_iterable(itertools.combinations(lengths[:-1], k) for k in range(min(buckets, len(lengths))))
    assert len(got) <= buckets and waste(got) == min(waste([*o, lengths[-1]]) for o in options)


def test_packing_is_whole_and_within_budget(docs, odd, empty):
    rows = packing.pack(docs, packing.word_count(docs["text"]), budget=2000).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts) and all(n == len(WORD.findall(texts[i])) for i, n in zip(rows.doc_id, rows.n_tokens, strict=True))
    sizes = rows.groupby(["bucket", "batch"]).agg(n=("place", "size"), top=("place", "max"), pad=("pad_to", "first"))
    assert (sizes.n == sizes.top + 1).all() and ((sizes.n * sizes["pad"] <= 2000) | (sizes.n == 1)).all()
    assert (rows.padding >= 0).all()
    assert packing.pack(odd, packing.word_count(odd["text"])).count() == len(ODD)
    assert packing.pack(empty, packing.word_count(empty["text"])).count() == 0


# --- sharding ----------------------------------------------------------------


def test_shards_slots_and_growth(docs, odd, empty):
    rows = sharding.shard_documents(docs, 24).toPandas()
    assert ((rows["shard"] == rows.grown_shard) | (rows.grown_shard == 24)).all() and rows["shard"].between(0, 23).all()
    for _, group in rows.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(s == len(texts[i]) + 8 and c == zlib.crc32(texts[i]) for i, s, c in zip(rows.doc_id, rows["size"], rows.text_crc32, strict=True))
    assert sharding.shard_documents(odd).count() == len(ODD) and sharding.shard_documents(empty).count() == 0


def test_weight_changes_move_rows_only_into_their_subtree(spark):
    ids = spark.range(20_000)
    old = sharding.Tree((((1.0, 1.0), (1.0, 2.0)), ((1.0,), (3.0, 1.0))))
    new = sharding.Tree((((1.0, 1.0), (1.0, 2.0)), ((1.0,), (3.0, 2.0))))
    both = ids.select(sharding.shard_of(F.col("id"), old).alias("a"), sharding.shard_of(F.col("id"), new).alias("b")).toPandas()
    moved = both[both.a != both.b]
    assert len(moved) and set(moved.b) <= {4, 5, 6}  # the second region
    assert set(moved[moved.a >= 4].b) <= {5, 6}
    share = both.a.value_counts(normalize=True)
    assert abs(share[5] - 0.3) < 0.02 and abs(share[0] - 0.1) < 0.02


# --- language model ----------------------------------------------------------


def plain_model(texts, held, mix=None):
    """Counts of a plain model: (tokens, single, pairs, before, p(h, w) under given weights)."""
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in texts.items()}
    taught = [t for i, t in tokens.items() if not held(i)]
    single = Counter(w for t in taught for w in t)
    pairs = Counter(p for t in taught for p in zip(["<s>", *t[:-1]], t, strict=True))
    before = Counter(h for t in taught for h in ["<s>", *t[:-1]])
    n, v = sum(single.values()), len(single)

    def p(h, w):
        c = before[h]
        m = mix[1 + int(np.log2(c)) if c else 0]
        return m[0] * pairs[h, w] / max(c, 1) + m[1] * single[w] / max(n, 1) + m[2] / (v + 1)

    return tokens, single, pairs, before, p


def plain_weights(pairs, single, before, n, v, rounds=100):
    """Expectation-maximisation on deleted counts, without any grid."""
    rows = {}
    for (h, w), k in pairs.items():
        c = before[h]
        p = ((k - 1) / (c - 1) if c > 1 else 0.0, (single[w] - 1) / (n - 1), 1 / (v + 1))
        rows.setdefault(1 + int(np.log2(c)), []).append((p, k))
    out = {}
    for b, found in rows.items():
        p, k = np.array([x for x, _ in found]), np.array([x for _, x in found], dtype=float)
        mix = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * mix
            share = share / share.sum(axis=1, keepdims=True) * k[:, None]
            mix = (share.sum(axis=0) + 0.5) / (share.sum() + 1.5)
        out[b] = mix
    return out


@pytest.mark.parametrize("contexts", [65_536, 8, 0])
def test_scores_equal_a_plain_model(spark, monkeypatch, contexts):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[min(59, int(x))] for x in rng.exponential(9, rng.integers(0, 40))) for _ in range(120)]
    texts = dict(enumerate([*texts, "New words only Here", "", None, "New w1 New w2 Here w3"]))
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    mixes = []
    learn = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda *a: mixes.append(learn(*a)) or mixes[-1])
    got = {r["doc_id"]: r for r in lm.score_documents(table, F.col("doc_id") % 5 == 2, contexts=contexts).collect()}
    tokens, single, pairs, before, p = plain_model(texts, lambda i: i % 5 == 2, mixes[0])
    n, v = sum(single.values()), len(single)
    for i, t in tokens.items():
        row = got[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (i % 5 == 2, len(t), n)
        assert row["n_known"] == sum(w in single for w in t)
        assert row["base_score"] == pytest.approx(sum(np.log10((single[w] + 1) / (n + v + 1)) for w in t))
        assert row["score"] == pytest.approx(sum(np.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)))
    # All words and one unknown word have probability 1 together, after any context, seen or not.
    for h in ["<s>", "w0", "w59", "never seen"]:
        assert sum(p(h, w) for w in single) + p(h, "unknown") == pytest.approx(1)
    for b, mix in plain_weights(pairs, single, before, n, v).items():
        assert mixes[0][b] == pytest.approx(mix, abs=0.05)


def test_scores_do_not_depend_on_partitions_or_the_table_of_common_words(spark, docs, monkeypatch):
    held = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2
    all_common = {r["doc_id"]: r for r in lm.score_documents(docs, held).collect()}
    monkeypatch.setattr(lm, "TOKENS", 3000)
    monkeypatch.setattr(lm, "LEAST_ENTRIES", 8)
    few = {r["doc_id"]: r for r in lm.score_documents(docs.repartition(7), held, contexts=50).collect()}
    for i, r in all_common.items():
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (few[i]["n_tokens"], few[i]["n_known"], few[i]["held_out"])
        assert r["base_score"] == pytest.approx(few[i]["base_score"]) and r["score"] == pytest.approx(few[i]["score"], rel=1e-3)
    out = [r for r in all_common.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_tables_with_little_or_nothing_to_learn_from(spark):
    texts = ["a b", "c", None, "a b c d", ""] * 9
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm.score_documents(table, F.lit(True)).collect()
    assert len(rows) == len(texts) and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    for held, parts in ((F.col("doc_id") != 3, 40), (F.col("doc_id") == 0, 1)):
        rows = lm.score_documents(table.repartition(parts), held).collect()
        assert len(rows) == len(texts) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "90")
        assert lm.score_documents(table.where("doc_id < 2"), F.col("doc_id") == 1).count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows_of_the_language_model(odd, empty):
    rows = lm.score_documents(odd, F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm.score_documents(empty, F.lit(False)).count() == 0
