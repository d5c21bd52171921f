"""What an index costs to build: tasks by bytes of text, and no tables of several times the texts' size."""

import os

from pyspark.sql import functions as F

from findloom.functions import text as tx
from findloom.operators import index as ix
from findloom.operators import parse as ps
from findloom.operators import rank as rk
from findloom.operators import recover as rc
from findloom.operators import search as sr
from findloom.sources import tables as tb

SMALL = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    rows = tb.posts(spark, SMALL).select("doc_id", "lang", F.lit("content").alias("field"), F.col("content").alias("text"), F.lit(100).alias("strength"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    whole = ix.build_terms(rows)
    monkeypatch.setattr(ix, "TASK_BYTES", size // 20)
    cut = ix.build_terms(rows)
    assert cut.rdd.getNumPartitions() >= 20 > whole.rdd.getNumPartitions()
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()


def test_terms_of_texts_are_those_of_their_words(spark):
    texts = ["Plain ASCII, text-2 the and I x9", "Größe über für Fuer ÄRGER Äß", "naïve œuvre Ⅷ İstanbul ΣΑΣ", "", "Straße\nmaße the", "été 10"]
    rows = spark.createDataFrame([(i, lang, "content", t, 100) for i, t in enumerate(texts) for lang in ("de", "en", "xx")], "doc_id long, lang string, field string, text string, strength int")
    got = ix.build_terms(rows, fields=["content"]).select("doc_id", "lang", "term", "content")
    words = rows.select("doc_id", "lang", F.explode(tx.words(F.col("text"))).alias("raw"))
    want = words.select("doc_id", "lang", F.explode(tx.forms(F.col("raw"), F.col("lang"))).alias("term")).groupBy("doc_id", "lang", "term").agg(F.count("*").cast("int").alias("content"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lookups_are_made_when_they_are_not_kept(spark, tmp_path):
    posts = [
        (1, "en", "post", "Old harbour", "The old harbour wall, built twice.", "", 1.0), (2, "en", "post", "Wall", "A harbour with an old wall", "", 1.0),
        (3, "en", "post", "Boats", "Boats by the Old  Harbour!", "", 1.0), (4, "de", "post", "Hafen", "Der alte Hafen", "", 1.0),
    ]
    df = spark.createDataFrame(posts, "doc_id long, lang string, post_type string, title string, content string, excerpt string, boost double")
    df = df.withColumn("post_date", F.lit("2024-01-01").cast("date"))
    rows = ix.field_rows(df, {"title": "title", "content": "content"})
    found = {}
    for lookups in (False, True):
        path = str(tmp_path / f"index-{lookups}")
        ix.publish_index(ix.build_terms(rows), ix.build_docs(df), path, lookups=lookups)
        ix.add_segment(spark, path, ix.build_terms(rows.where("doc_id = 4")), ix.build_docs(df.where("doc_id = 4")))
        ix.fold_segments(spark, path)
        assert os.path.isdir(f"{path}/deletions") == os.path.isdir(f"{path}/positions") == lookups
        index = ix.read_index(spark, path)
        assert (index.positions is not None) == lookups
        asked = spark.createDataFrame([("en", "harbuor"), ("de", "haven")], "lang string, token string")
        q = spark.createDataFrame([(7, "en", '"old harbour"'), (8, "en", "old wall")], "qid long, lang string, query string")
        q, qv = ps.parse(q)
        ranked = rk.rank(q, ps.expand_prefixes(qv, index.terms, index.vocabulary), index.terms, index.docs, positions=index.positions)["ranked"]
        found[lookups] = (
            sorted(map(tuple, rc.closest_terms(asked, index.terms, index.vocabulary, index.deletions).collect())),
            sorted(map(tuple, ranked.select("qid", "doc_id", "place", "score", "phrase").collect())),
        )
    assert found[False] == found[True]
    assert {r[0:2] for r in found[False][1]} == {(7, 1), (7, 3), (8, 1), (8, 2)} and len(found[False][0]) == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def first_line(lines, *needed):
    return next(i for i, line in enumerate(lines) if any(n in line for n in needed))


def test_texts_are_cut_into_words_once(spark):
    lines = plan_of(tb.build_index(spark, SMALL)[0])
    below = lines[first_line(lines, "REPARTITION_BY_NUM") :]
    assert not [line for line in below if "regexp_extract_all" in line]


def test_texts_without_words_have_no_terms(spark):
    rows = [(i, lang, "content", text, 100) for i, text in enumerate(["", "...", "ä - !", "Ärger", "a", "und"]) for lang in ("de", "en")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, field string, text string, strength int")
    got = {tuple(r) for r in ix.build_terms(df).select("doc_id", "lang", "term").collect()}
    assert got == {(3, "de", "arger"), (3, "de", "aerger"), (3, "en", "arger"), (5, "en", "und")}


def test_only_wanted_texts_are_normalized(spark):
    texts = tb.posts(spark, SMALL).select("doc_id", "lang", "content", "excerpt")
    lines = plan_of(rk.phrases_of(texts.where("doc_id < 3").select(F.lit(1).alias("qid"), "doc_id", "lang", F.array(F.lit("the the")).alias("wanted")), texts))
    scan = first_line(lines, "excerpt#", "documents.parquet")
    made = [i for i, line in enumerate(lines) if "regexp_replace" in line]
    joins = [i for i, line in enumerate(lines) if "BroadcastHashJoin [doc_id" in line and "lang" in line and "phrase" not in line]
    assert made and joins and max(made) < max(joins) and scan


def test_an_index_keeps_only_the_fields_that_it_is_told(spark, tmp_path):
    posts = [(i, "en", "post", f"harbour {i}", "an old wall by the harbour", "", 1.0) for i in range(6)]
    df = spark.createDataFrame(posts, "doc_id long, lang string, post_type string, title string, content string, excerpt string, boost double")
    df = df.withColumn("post_date", F.lit("2024-01-01").cast("date"))
    rows = ix.field_rows(df, {"title": "title", "content": "content"})
    alt = ix.named_rows(df.where("doc_id = 5").select("doc_id", "lang", F.lit("harbour lantern").alias("name")), "alt")
    q, qv = ps.parse(spark.createDataFrame([(1, "en", "harbour wall"), (2, "en", "lantern")], "qid long, lang string, query string"))
    found = {}
    for fields in (None, ["title", "content"]):
        path = str(tmp_path / f"index-{fields is None}")
        ix.publish_index(ix.build_terms(rows), ix.build_docs(df), path, fields=fields)
        assert ("alt" in ix.read_index(spark, path).terms.columns) == (fields is None)
        steps = []
        for _ in range(2):
            at = ix.read_index(spark, path)
            ranked = rk.rank(q, ps.expand_prefixes(qv, at.terms, at.vocabulary), at.terms, at.docs)["ranked"]
            steps.append((
                sorted(map(tuple, ranked.select("qid", "doc_id", "place", "score", F.array_join("fields", ",")).collect())),
                sorted(map(tuple, at.vocabulary.select("lang", "term", "docs", "strong").collect())),
                [tuple(r) for r in ix.statistics(spark, path).drop("words").collect()],
            ))
            changed = df.where("doc_id = 5")
            ix.add_segment(spark, path, ix.build_terms(rows.where("doc_id = 5").unionByName(alt)), ix.build_docs(changed))
        at = ix.read_index(spark, path)
        assert at.terms.where("alt is null").isEmpty() and at.terms.where("alt > 0").count() == 2
        found[fields is None] = steps
    assert found[True] == found[False]
    assert [r[1] for r in found[True][1][0] if r[0] == 2] == [5]


def test_texts_are_not_shuffled_to_a_page(spark, monkeypatch):
    index = tb.index(spark, SMALL)
    asked = tb.benchmark_queries(spark, SMALL).where("qid < 40")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = []
    try:
        for most in (rk.VARIANTS_MOST, -1):
            monkeypatch.setattr(rk, "VARIANTS_MOST", most)
            lines = plan_of(sr.search(asked, index, sr.Request(languages=("de", "en", "es", "fr"))).results)
            shuffled.append([line for line in lines if "SortMergeJoin [doc_id" in line and "lang" in line and "Inner" in line])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not shuffled[0] and shuffled[1], shuffled
