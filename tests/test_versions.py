"""Segments of an index, the plans of searches in it, misspelt words, and streams of searches and clicks."""

import glob

import pytest
from pyspark.sql import functions as F

from findloom.functions import text as tx
from findloom.operators import analytics as an
from findloom.operators import cache as ch
from findloom.operators import index as ix
from findloom.operators import maintain as mt
from findloom.operators import parse as ps
from findloom.operators import rank as rk
from findloom.operators import recover as rc
from findloom.operators import search as sr
from findloom.streaming import log as sl

SCHEMA = "doc_id long, lang string, post_type string, title string, content string, boost double, post_date string"
WORDS = ["river", "stone", "bridge", "harbour", "market", "garden", "castle", "forest", "valley", "meadow", "lantern", "orchard"]


def posts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("excerpt", F.lit(""))


def row(i, text=None, lang="en"):
    body = " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 6)) + f" token{i:04d}"
    return (i, lang, "post", f"{WORDS[i % len(WORDS)]} {i}", text or body, 1.0, "2024-01-01")


def terms_of(p):
    return ix.build_terms(ix.field_rows(p, {"title": "title", "content": "content"}), fields=["title", "content"])


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def rows_in(spark, path, segment):
    return sum(spark.read.parquet(f).count() for f in glob.glob(f"{path}/*/segment={segment}") if glob.glob(f"{f}/**/*.parquet", recursive=True))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    p = posts(spark, [row(i, lang=["en", "fr"][i % 2]) for i in range(300)])
    ix.publish_index(terms_of(p), ix.build_docs(p), path, "r1", buckets=4)
    return path


def same(spark, path, p, failed=()):
    """Whether the index at ``path`` is that of the posts built at once."""
    whole, index = terms_of(p), ix.read_index(spark, path)
    assert rows_of(index.terms.select(whole.columns)) == rows_of(whole)
    names = ["lang", "term", "docs", "strong"]
    assert rows_of(index.vocabulary.select(names)) == rows_of(ix.vocabulary_of(whole).select(names))
    assert {r["doc_id"] for r in index.docs.collect()} == {r["doc_id"] for r in p.collect()}
    assert {r["doc_id"] for r in mt.failures(index.docs).collect()} == set(failed)
    stats = {r["lang"]: r for r in ix.statistics(spark, path).collect()}
    for r in whole.groupBy("lang").agg(F.count("*").alias("rows"), F.count_if(F.col("title") > 0).alias("in_title"), F.count_distinct("term").alias("words")).collect():
        mine = stats.pop(r["lang"])
        assert (mine["rows"], mine["in_title"]) == (r["rows"], r["in_title"]) and mine["words"] > 0.95 * r["words"]
        assert mine["docs"] == p.where(F.col("lang") == r["lang"]).count()
    assert not stats
    known = {(r["lang"], r["term"]) for r in whole.where("char_length(term) >= 3").select("lang", "term").collect()}
    assert {(r["lang"], r["term"]) for r in index.deletions.select("lang", "term").distinct().collect()} >= known


def test_a_small_refresh_writes_little_and_gives_the_whole_index(spark, built):
    rows = [row(i, lang=["en", "fr"][i % 2]) for i in range(300) if i != 17]
    rows[3] = row(3, "changed words of a lantern", "fr")
    rows.append(row(601, "an altogether newcomer"))
    p = posts(spark, rows)
    errors = spark.createDataFrame([(5, "unreadable")], "doc_id long, error string")
    indexed = []

    def again(fresh):
        indexed.extend(r["doc_id"] for r in fresh.select("doc_id").collect())
        return terms_of(p.join(fresh.select("doc_id"), "doc_id", "left_semi"))

    plan = mt.refresh_published(spark, built, ix.build_docs(p), again, errors)
    actions = {r["doc_id"]: r["action"] for r in plan.where("action <> 'unchanged'").collect()}
    assert actions == {17: "removed", 3: "indexed", 601: "indexed", 5: "failed"} and sorted(indexed) == [3, 601]
    same(spark, built, p, [5])
    first, second = (r["segments"][-1] for r in ix.versions(spark, built).orderBy("number").collect()[:2])
    assert 0 < rows_in(spark, built, second) < 0.03 * rows_in(spark, built, first)
    assert ix.read_index(spark, built, 1).docs.count() == 300  # older versions stay as they are
    # A document that comes back, one that changes again, and an empty change.
    rows = [*rows, row(17, lang="fr")]
    rows[3] = row(3, "changed once more", "en")
    p = posts(spark, rows)
    mt.refresh_published(spark, built, ix.build_docs(p), lambda fresh: terms_of(p.join(fresh.select("doc_id"), "doc_id", "left_semi")))
    same(spark, built, p)
    ix.fold_segments(spark, built)
    same(spark, built, p)
    for r in ix.statistics(spark, built).collect():  # the sketch of a folded index has no hidden terms
        words = terms_of(p).where(F.col("lang") == r["lang"]).select("term").distinct().count()
        assert abs(r["words"] - words) <= 0.05 * words
    assert len(ix.versions(spark, built).orderBy(F.desc("number")).first()["segments"]) == 1


def test_many_segments_or_hidden_ids_are_folded(spark, tmp_path, monkeypatch):
    path, p = str(tmp_path), posts(spark, [row(i) for i in range(12)])
    ix.publish_index(terms_of(p), ix.build_docs(p), path, "r1", buckets=2)
    monkeypatch.setattr(ix, "HIDDEN_MOST", 3)
    gone = lambda low, high: p.where(F.col("doc_id").between(low, high)).select("doc_id")
    none = p.where("false")
    for low, high, segments in ((0, 1, 2), (2, 5, 1)):
        ix.add_segment(spark, path, terms_of(none), ix.build_docs(none), gone(low, high))
        assert len(ix.versions(spark, path).orderBy(F.desc("number")).first()["segments"]) == segments
    same(spark, path, p.where("doc_id > 5"))
    monkeypatch.setattr(ix, "SEGMENTS_MOST", 1)
    ix.add_segment(spark, path, terms_of(none), ix.build_docs(none), gone(6, 6))
    same(spark, path, p.where("doc_id > 6"))
    ix.add_segment(spark, path, terms_of(none), ix.build_docs(none), gone(0, 99))
    assert ix.read_index(spark, path).terms.count() == 0 and ix.read_index(spark, path).vocabulary.count() == 0


def test_a_search_neither_shuffles_nor_broadcasts_the_index_and_reads_few_buckets(spark, built):
    index = ix.read_index(spark, built, 1)
    asked = spark.createDataFrame([(1, "en", "token0002"), (2, "en", "token0004")], "qid long, lang string, query string")
    hits = rk.probe(ps.parse(asked)[1], index.terms, ["title", "content"])
    assert sorted(r["doc_id"] for r in hits.collect()) == [2, 4]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    names = {n: i for i, n in enumerate(plan.split("\n"))}
    side = [line for line in names if "Exchange" in line and "bucket" in line]
    assert side and all("BroadcastExchange" in line for line in side)
    scan = [m for m in _metrics(hits._jdf.queryExecution().executedPlan()) if "numPartitions" in m]
    every = len(glob.glob(f"{built}/terms/segment=*/lang=*/bucket=*"))
    assert scan and min(m["numPartitions"] for m in scan) <= 2 < every


def test_a_query_asked_again_is_not_ranked_again(spark, built, monkeypatch):
    index = ix.read_index(spark, built, 1)
    calls = []
    plain = rk.rank
    monkeypatch.setattr(rk, "rank", lambda q, *more: calls.append({r["query"] for r in q.collect()}) or plain(q, *more))
    schema = "qid long, lang string, query string"
    first = ps.parse(spark.createDataFrame([(1, "en", "token0002"), (2, "en", "nowhere"), (3, "fr", "Lantern bridge"), (4, "en", "token0002")], schema))
    want = plain(first[0], ps.expand_prefixes(first[1], index.terms, index.vocabulary), index.terms, index.docs)
    for _ in range(2):
        got = ch.ranked_once(*first, index)
        for frame in want:
            assert rows_of(got[frame]) == rows_of(want[frame].select(got[frame].columns)), frame
    assert len(calls) == 1 and len(calls[0]) == 3
    assert not any("/terms/" in f or "/docs/" in f for f in got["ranked"].inputFiles())
    again = ps.parse(spark.createDataFrame([(9, "en", "nowhere"), (8, "en", "token0004")], schema))
    assert [(r["qid"], r["doc_id"]) for r in ch.ranked_once(*again, index)["ranked"].collect()] == [(8, 4)]
    assert calls[1:] == [{"token0004"}]
    ch.ranked_once(*again, index, rk.Options(fallback=False))
    ch.ranked_once(*again, index, rk.Options(score=lambda score, doc: score))
    assert len(calls) == 4 and ch.options_key(rk.Options(score=lambda score, doc: score)) is None


def test_results_tell_why_they_are_there(spark, tmp_path):
    p = posts(spark, [row(1, "by the water"), row(2, "harbour town"), row(3, "nothing of it")]).withColumn("title", F.concat(F.lit("Walk "), "doc_id"))
    places = spark.createDataFrame(
        [(1, "en", 0, "continent", "Ostland", ""), (1, "en", 1, "city", "Harbour", ""), (2, "en", 0, "city", "Harbour", "")],
        "doc_id long, lang string, pos int, level string, name string, tag string",
    )
    tags = ix.named_rows(spark.createDataFrame([(3, "en", "harbour life")], "doc_id long, lang string, name string"), "taxonomy")
    rows = ix.field_rows(p, {"title": "title", "content": "content"}, ix.place_rows(places).unionByName(tags))
    ix.publish_index(ix.build_terms(rows), ix.build_docs(p), str(tmp_path), "r1", buckets=2)
    asked = spark.createDataFrame([(1, "en", "harbour")], "qid long, lang string, query string")
    index, signals = ix.read_index(spark, str(tmp_path)), ix.signals_of(rows)
    for keep in (False, True):
        found = sr.search(asked, index, sr.Request(keep=keep), signals=signals).results
        got = {r["doc_id"]: (r["reason"] and tuple(r["reason"]), r["places"], r["tags"]) for r in found.collect()}
        assert got == {1: (("place", "Harbour", "Ostland"), ["Ostland", "Harbour"], []), 2: (None, ["Harbour"], []), 3: (("tag", "harbour life", None), [], ["harbour life"])}
    hooked = sr.search(asked, index, sr.Request(reason=lambda why: why["kind"], excerpts=False), signals=signals).results
    assert {r["doc_id"]: r["reason"] for r in hooked.collect()} == {1: "place", 2: "place", 3: "tag"}


def _metrics(node):
    """The metrics of the scans of a plan that ran."""
    kind = node.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        metrics = node.metrics()
        return [{k: metrics.apply(k).value() for k in metrics.keys().mkString(",").split(",")}]
    if kind == "AdaptiveSparkPlanExec":
        below = [node.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    return [m for x in below for m in _metrics(x)]


def plain_distance(a, b):
    row_ = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row_[0] = row_[0], i
        for j, y in enumerate(b, 1):
            last, row_[j] = row_[j], min(row_[j] + 1, row_[j - 1] + 1, last + (x != y))
    return row_[-1]


def test_closest_terms_equal_a_search_of_all_terms(spark):
    stems = ["mountains", "mountain", "fountain", "fountains", "mounting", "counting", "counts", "mints", "mint", "mists", "most", "mst", "moat"]
    long = ["donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtsgesellschaften", "donaudampfschiffsgesellschaft", "donaudampfschifffahrtskapitan"]
    rows = [(i, "en", t, i % 3) for i, t in enumerate(stems + long + ["été", "étée", "#mount"])] + [(40 + i, "fr", t, 1) for i, t in enumerate(stems[:4])]
    terms = spark.createDataFrame(
        [(i, lang, t, title, 1) for i, lang, t, title in rows], "doc_id long, lang string, term string, title int, content int"
    ).withColumns({f: F.lit(0) for f in ("place", "hub", "guide")})
    asked = ["mountan", "mountainss", "mutain", "fountainz", "mits", "mnit", "mostt", "mointing", "xountain", "mount", "mountains", "most", "étéé", "mst",
             "donaudampfschifffahrtsgeselschaft", "donaudampfschiffahrtsgesellschaften", "donaudmpfschifffahrtskapitn", "donaudampfschifffahrtsgesellschaftenxxx"]
    words = spark.createDataFrame([(lang, w) for w in asked for lang in ("en", "fr", "de")], "lang string, token string")
    want = {}
    for lang, w in {(lang, w) for w in asked for lang in ("en", "fr", "de") if len(w) >= 4}:
        near = [(plain_distance(w, t), -int(title > 0), -1, t) for _, known, t, title in rows if known == lang and t[0] == w[0]]
        near = [n for n in near if 1 <= n[0] <= (1 if len(w) <= 5 else 2)]
        if near:
            want[lang, w] = (min(near)[3], min(near)[0])
    got = {(r["lang"], r["token"]): (r["term"], r["distance"]) for r in rc.closest_terms(words, terms).collect()}
    assert got == want and len(got) > 12


def test_phrases_by_position_are_those_in_the_texts(spark):
    texts = ["the river the river bend", "a river. The river, bend!", "river bend the", "rivers the bend", "", None, "Über the  RIVER-bend", "the the the river"]
    docs = spark.createDataFrame([(i, "en", t, None if i % 2 else f"the end {i}") for i, t in enumerate(texts)], "doc_id long, lang string, content string, excerpt string")
    phrases = ["the river", "river bend", "the the", "the the the the", "uber the river bend", "bend the end", "the river the river bend", "nothing here", "river"]
    rows = docs.select(F.lit(1).alias("qid"), "doc_id", "lang", F.array(*map(F.lit, phrases)).alias("wanted"))
    got = {r["doc_id"]: set(r["found"]) for r in rk.phrases_in(rows, ix.positions_of(docs)).collect()}
    body = tx.normalize(F.concat_ws("\n", F.coalesce("content", F.lit("")), F.coalesce("excerpt", F.lit(""))))
    held = docs.select("doc_id", *(tx.has_phrase(body, F.lit(p)).alias(p) for p in phrases)).collect()
    assert got == {r["doc_id"]: {p for p in phrases if r[p]} for r in held if any(r[p] for p in phrases)} and len(got) == 5


# --- streams -----------------------------------------------------------------


def arriving(spark, path, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    kind = spark.read.parquet(path).schema
    return spark.read.parquet(path), spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("cap", [0, 2, 3, 100])
def test_recorded_streams_equal_recorded_tables(spark, tmp_path, cap):
    day = "2024-05-0{} {:02d}:00:00"
    batches = [
        [("Blue  Lake", "en", day.format(1, 8), 7, "none"), ("qwzt", "en", day.format(1, 9), 0, "none")],
        [("third", "en", day.format(1, 10), 1, "none"), ("third", "de", day.format(1, 11), 1, "none"), ("fourth", "en", day.format(2, 1), 4, "or")],
        [("blue lake", "en", day.format(1, 12), 9, "or"), ("fifth", "en", day.format(1, 13), 1, "none"), ("qwzt'\"(.,", "en", day.format(1, 14), 0, "none")],
        [("sixth", "en", day.format(2, 2), 4, ""), ("fourth", "en", day.format(2, 3), 5, "none"), ("", "en", day.format(2, 3), 5, "none")],
    ]
    table, stream = arriving(spark, str(tmp_path / "raw"), batches, "query string, lang string, ts string, results long, fallback string")
    sl.run_recorder(stream, str(tmp_path / "log"), cap)
    want = rows_of(an.record_searches(table, cap))
    assert rows_of(sl.recorded(spark, str(tmp_path / "log"))) == want and want
    sl.run_recorder(stream, str(tmp_path / "log"), cap)  # nothing new
    assert rows_of(sl.recorded(spark, str(tmp_path / "log"))) == want


def test_streams_of_clicks_and_searches(spark, tmp_path):
    schema = "kind string, query string, lang string, ts string, post_id long, rank int, source string, view string"
    hit = lambda query, ts, post, view, source="result": ("c", query, "en", ts, post, 1, source, view)
    asked = lambda query, ts: ("s", query, "en", ts, None, None, None, None)
    batches = [
        [asked("a", "2024-05-01 08:00:00"), hit("a", "2024-05-01 09:00:00", 1, None), hit("a", "2024-05-01 09:00:00", 1, None), hit("z", "2024-05-01 09:00:00", 1, "v")],
        [hit("a", "2024-05-02 23:59:59", 2, "v1"), hit("b", "2024-05-02 10:00:00", 2, "v2"), hit("a", "2024-05-02 10:00:00", 1, "v1"), hit("a", "2024-05-02 11:00:00", 2, "v1")],
        [asked("b", "2024-05-02 12:00:00"), hit("a", "2024-05-03 00:00:00", 1, "v3"), hit("b", "2024-05-03 10:00:00", 9, "v4"), hit("b", "2024-05-03 10:00:00", 1, "v5", "odd")],
        [hit("b", "2024-05-03 12:00:00", 1, "v6"), hit("b", "2024-05-03 12:30:00", 1, None), hit("b", "2024-05-04 00:00:00", 1, "v7")],
    ]
    table, stream = arriving(spark, str(tmp_path / "raw"), batches, schema)
    docs = spark.createDataFrame([(1, "en"), (2, "en"), (9, "fr")], "doc_id long, lang string")
    clicks, searches = (lambda t: t.where("kind = 'c'")), (lambda t: t.where("kind = 's'"))
    once = an.read_clicks(clicks(table))
    want = an.click_counts(an.valid_clicks(once, docs, searches(table).select("query", "lang", F.to_date("ts").alias("day"))))
    sl.run_clicks(clicks(stream), str(tmp_path / "clicks"), lambda batch: an.possible_clicks(batch, docs), searches(stream), "3 days")
    found = rows_of(sl.counted_clicks(spark, str(tmp_path / "clicks")))
    assert found == rows_of(want) and sum(dict(r)["clicks"] for r in found) == 7


def test_clicks_without_a_view_all_count(spark, tmp_path):
    rows = [(q, "en", "2024-05-01 09:00:00", 1, 1, "result", v) for q, v in (("a", None), ("a", None), ("b", None), ("a", "v"), ("b", "v"))]
    schema = "query string, lang string, ts string, post_id long, rank int, source string, view string"
    assert an.read_clicks(spark.createDataFrame(rows, schema)).count() == 4
    table, stream = arriving(spark, str(tmp_path / "raw"), [rows], schema)
    sl.run_clicks(stream, str(tmp_path / "clicks"), lambda batch: batch.withColumn("day", F.to_date("ts")))
    assert sum(r["clicks"] for r in sl.counted_clicks(spark, str(tmp_path / "clicks")).collect()) == 4


def test_changes_are_indexed_once_each(spark, tmp_path):
    spark.createDataFrame([("post", 1), ("post", 1), ("hub", 2)], "kind string, id long").coalesce(1).write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema("kind string, id long").parquet(str(tmp_path / "raw"))
    closure = spark.createDataFrame([(7, 2), (2, 2)], "doc_id long, hub long")
    images = spark.createDataFrame([], "doc_id long, image_id long")
    seen = []
    sl.run_changes(stream, str(tmp_path / "state"), lambda ids: seen.extend(r["doc_id"] for r in ids.collect()), lambda changed: mt.affected_posts(changed, closure, images))
    assert sorted(seen) == [1, 2, 7]
