"""Scenarios of the search engine on small literal tables."""

import pytest
from pyspark.sql import functions as F

from findloom.functions import decode, lexicon
from findloom.functions import text as tx
from findloom.operators import analytics as an
from findloom.operators import index as ix
from findloom.operators import maintain as mt
from findloom.operators import parse as ps
from findloom.operators import present as pr
from findloom.operators import rank as rk
from findloom.operators import recover as rc
from findloom.operators import search as sr
from findloom.sources import html as ht
from findloom.streaming import log as sl


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Île Édimbourg côte côté", "ile edimbourg cote cote"),
        ("Straße cœur ærø oslo", "strasse coeur aero oslo"),
        ("Île", "ile"),
        ("L’eau Royaume-Uni aujourd'hui", "l eau royaume uni aujourd hui"),
        ("", ""),
    ],
)
def test_normalize(spark, text, found):
    assert one(spark, tx.normalize, text) == found


def test_tokens_keep_stopwords(spark):
    assert one(spark, tx.tokens, "Le vélo, et la mer !") == ["le", "velo", "et", "la", "mer"]


@pytest.mark.parametrize(
    ("word", "lang", "forms"),
    [("Bäcker", "de", ["backer", "baecker"]), ("Bäcker", "fr", ["backer"]), ("und", "de", []), ("und", "en", ["und"])],
)
def test_forms(spark, word, lang, forms):
    row = spark.createDataFrame([(word, lang)], "w string, l string")
    assert row.select(tx.forms(F.col("w"), F.col("l")).alias("x")).first()["x"] == forms


def test_quoted_phrases_have_two_words(spark):
    text = '"Blue-green lake" «vert clair» “lone” „grauer Stein“ "blue green lake"'
    assert one(spark, tx.quoted, text) == ["blue green lake", "vert clair", "grauer stein"]


POSTS = [
    (1, "fr", "page", "Valmora", "Le guide de Valmora, port et collines.", 1.15, "2023-02-01"),
    (2, "fr", "post", "Que manger à Valmora", "Des olives et du pain, au marché de Valmora.", 1.0, "2023-02-02"),
    (3, "fr", "post", "Un phare au bout du monde", "Le phare au bout du monde domine Valmora et ses grottes.", 1.0, "2023-02-03"),
    (4, "fr", "post", "Trésor de Quillan le pirate", "La carte du pirate Quillan.", 1.0, "2023-02-04"),
    (5, "fr", "post", "Quillan à vélo", "Une grotte et un moulin.", 1.0, "2023-02-05"),
    (6, "en", "post", "Riverside hikes", "A hike along the river.", 1.0, "2023-02-06"),
    (7, "de", "post", "Bäckerei", "Der Bäcker am Fluß bäckt Brötchen.", 1.0, "2023-02-07"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    posts = spark.createDataFrame(
        POSTS, "doc_id long, lang string, post_type string, title string, content string, boost double, post_date string"
    ).withColumn("excerpt", F.lit(""))
    places = spark.createDataFrame(
        [(5, "fr", 0, "continent", "Ostland", ""), (5, "fr", 1, "country", "Méridie", ""), (5, "fr", 2, "city", "Brume", "")],
        "doc_id long, lang string, pos int, level string, name string, tag string",
    )
    terms = ix.build_terms(ix.field_rows(posts, {"title": "title", "content": "content"}, ix.place_rows(places)))
    return terms.persist(), ix.build_docs(posts).persist()


def search(spark, corpus, text, lang="fr", **options):
    terms, docs = corpus
    q, qv = ps.parse(spark.createDataFrame([(1, lang, text)], "qid long, lang string, query string"))
    return rk.rank(q, ps.expand_prefixes(qv, terms), terms, docs, rk.Options(**options))


def ids(found):
    return [r["doc_id"] for r in found["ranked"].orderBy("place").collect()]


def test_ranking(spark, corpus):
    assert ids(search(spark, corpus, "valmora"))[0] == 1
    assert set(ids(search(spark, corpus, "VALMORA"))) == {1, 2, 3}
    assert ids(search(spark, corpus, "hiking", "en")) == [6] and ids(search(spark, corpus, "valmora", "en")) == []
    assert ids(search(spark, corpus, "que manger à Valmora"))[0] == 2
    assert ids(search(spark, corpus, "le la les")) == []
    assert ids(search(spark, corpus, "v%C3%A9lo")) == ids(search(spark, corpus, "vtt")) == [5]


@pytest.mark.parametrize("text", ["bäcker", "baecker", "backer"])
def test_german_spellings(spark, corpus, text):
    assert ids(search(spark, corpus, text, "de")) == [7]


def test_plural_and_prefix(spark, corpus):
    # The word as asked comes first; the singular weighs 0.85 and a longer word 0.5.
    assert ids(search(spark, corpus, "grottes")) == [3, 5]
    assert ids(search(spark, corpus, "grotte")) == [5, 3]


def test_fallback_and_missing_words(spark, corpus):
    found = search(spark, corpus, "valmora zeppelin")
    assert {r["fallback"] for r in found["ranked"].collect()} == {"or"}
    assert [r["raw"] for r in found["missing"].collect()] == ["zeppelin"]
    assert ids(search(spark, corpus, "valmora zeppelin", fallback=False)) == []


def test_quotes_types_weights_and_hooks(spark, corpus):
    assert ids(search(spark, corpus, '"phare au bout du monde"')) == [3]
    assert ids(search(spark, corpus, "valmora", post_types=("page",))) == [1]
    assert ids(search(spark, corpus, "valmora", post_types=("none",))) == []
    assert ids(search(spark, corpus, "méridie")) == [5]
    assert ids(search(spark, corpus, "méridie", weights={"place": 0})) == []
    assert ids(search(spark, corpus, "valmora", score=lambda score, doc: F.when(doc == 3, score + 100).otherwise(score)))[0] == 3
    changed = search(spark, corpus, "valmora", results=lambda r: r.where("doc_id <> 1").withColumn("score", -F.col("doc_id").cast("double")))
    assert ids(changed) == [2, 3]


def test_rarity_and_amount_values(spark):
    row = spark.range(1).select(
        *(F.round(rk.amount("content", F.lit(float(n))), 5).alias(f"a{n}") for n in (1, 2, 5, 20)),
        F.round(rk.rarity(F.lit(1600.0), F.lit(10.0)), 4).alias("r"), rk.rarity(F.lit(1600.0), F.lit(1600.0)).alias("low"),
        rk.rarity(F.lit(4.0), F.lit(1.0)).alias("top"),
    ).first()
    assert list(row) == [1.0, 1.41589, 1.96566, 2.79744, 0.8804, 0.2, 1.0]


def test_pins_and_guides(spark, corpus):
    terms, docs = corpus
    q, qv = ps.parse(spark.createDataFrame([(1, "fr", "VALMORA"), (2, "fr", "zeppelin")], "qid long, lang string, query string"))
    ranked = rk.rank(q, ps.expand_prefixes(qv, terms), terms, docs)["ranked"]
    lines = spark.createDataFrame([(0, "Valmora = 4, 6"), (1, "valmora ! = 3 3; x9, 0"), (2, "zeppelin=5"), (3, "no pins here"), (4, " = 1")], "line int, text string")
    pins = rk.read_pins(lines)
    assert [(r["line"], r["doc_id"], r["pos"]) for r in pins.orderBy("line", "pos").collect()] == [(0, 4, 0), (0, 6, 1), (1, 3, 0), (2, 5, 0)]
    out = rk.apply_pins(ranked, q, pins, docs).where("qid = 1").orderBy("place").collect()
    assert [(r["doc_id"], r["pinned"]) for r in out][:2] == [(4, True), (3, True)]
    assert out[0]["score"] == 0.0 and [r["doc_id"] for r in out][2:] == [1, 2]
    only = rk.apply_pins(ranked.withColumn("fallback", F.lit("or")), q, pins, docs, rk.Options(post_types=("post",)))
    assert [(r["doc_id"], r["fallback"]) for r in only.where("qid = 2").collect()] == [(5, "none")]
    hubs = spark.createDataFrame([(1,)], "hub long")
    guides = rk.split_guides(ranked.withColumn("pinned", F.lit(False)), hubs, 3)
    assert [r["doc_id"] for r in guides.where("guide").collect()] == [1]


def test_search_in_one_call(spark, corpus, tmp_path):
    ix.publish_index(*corpus, str(tmp_path), "r1")
    ix.publish_index(corpus[0].where("doc_id <> 2"), corpus[1].where("doc_id <> 2"), str(tmp_path), "r2")
    index = ix.read_index(spark, str(tmp_path), 1)
    assert ix.read_index(spark, str(tmp_path)).docs.count() == 6 and ix.versions(spark, str(tmp_path)).count() == 2
    asked = spark.createDataFrame([(1, "FR ", "Valmora"), (2, None, "valmora zeppelin"), (3, "de", "Bäcker")], "qid long, lang string, query string")
    hubs = spark.createDataFrame([(1,)], "hub long")
    found = sr.search(asked, index, sr.Request(per_page=2, guides=1, explain=True), hubs=hubs)
    totals = {r["qid"]: (r["lang"], r["total"], r["pages"], r["fallback"], r["missing_words"]) for r in found.totals.collect()}
    assert totals == {1: ("fr", 2, 1, "none", []), 2: ("fr", 3, 2, "or", ["zeppelin"]), 3: ("de", 1, 1, "none", [])}
    rows = {(r["qid"], r["rank"]): r for r in found.results.collect()}
    assert rows[1, 1]["doc_id"] == 2 and rows[1, 1]["title_html"].endswith('<mark class="search-highlight">Valmora</mark>')
    assert rows[3, 1]["title_html"] == '<mark class="search-highlight">Bäckerei</mark>' and rows[3, 1]["excerpt"].count("<mark") == 1
    assert rows[1, 1]["matched_terms"] == ["valmora"] and rows[1, 1]["matched_fields"] == ["content", "title"]
    assert [(r["qid"], r["doc_id"]) for r in found.guides.collect()] == [(1, 1)]
    assert {r["what"] for r in found.explain_whole.where("qid = 2").collect()} >= {"partial match", "document boost"}
    assert found.explain.where("qid = 3 and field = 'title' and kind = 'prefix'").count() == 1


def test_did_you_mean(spark, corpus):
    asked = spark.createDataFrame(
        [(1, "fr", "valmra"), (2, "fr", "tresr quilan"), (3, "fr", "zeppelin"), (4, "fr", "valmora"), (5, "fr", '"valmra quillan"')],
        "qid long, lang string, query string",
    )
    found = {r["qid"]: r["suggestion"] for r in rc.did_you_mean(asked, *corpus).collect()}
    assert found == {1: "valmora", 2: "tresor quillan"}


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("/un-phare-au-bout-du-monde/", "un phare au bout du monde"),
        ("https://a.example/en/2019/08/stone_bridge.html?x=1#y", "stone bridge"),
        ("/sentiers/brume/", "brume sentiers"),
        ("/category/moulins/page/3/", "moulins"),
        ("/pr%C3%A9s-sal%C3%A9s", "pres sales"),
        ("/feed.xml", ""), ("/wp-json/v2", ""), ("/.git/x", ""), ("/a/b/c/d/e/f/g", ""), ("/ab", ""), ("", ""),
        ("/" + "long-" * 50, ""),
    ],
)
def test_path_words(spark, path, found):
    table = spark.createDataFrame([(path,)], "url string")
    assert rc.path_words(table, "url").first()["words"] == found


@pytest.mark.parametrize(
    ("query", "junk"),
    [
        ("blue lagoon", False), ("cafe (terrace)", False), ("rock'n'roll", False), ("50% off", False),
        ("benchmark(9)", True), ("x UNION ALL SELECT y", True), ("lake'\"(.),", True), ("lagoon/de-at", True),
        ("caf%25C3%25A9", True), ("1>0", True), ("{{7*7}}", True), ("word " * 25, True), ("\"a\" \"b\"", True), ("..\\win", True),
        ("caf%E9", True), ("tea or 3 = 3", True),
    ],
)
def test_junk(spark, query, junk):
    assert an.with_junk(spark.createDataFrame([(query,)], "query string")).first()["junk"] is junk


def test_recording(spark):
    rows = [
        ("Blue  Lake", "en", "2024-05-01 08:00:00", 7, "none", 1), ("blue lake", "en", "2024-05-01 09:00:00", 5, "or", 1),
        ("blue lake", "en", "2024-05-01 09:30:00", 5, "or", 2), ("qwzt", "en", "2024-05-01 10:00:00", 0, "none", 1),
        ("qwzt'\"(.,", "en", "2024-05-01 11:00:00", 0, "none", 1), ("qwzt", "en", "2024-05-02 11:00:00", 0, "none", 1),
        ("third", "en", "2024-05-01 12:00:00", 1, "none", 1), ("", "en", "2024-05-01 12:00:00", 1, "none", 1),
    ]
    searches = spark.createDataFrame(rows, "query string, lang string, ts string, results long, fallback string, page int")
    log = {(r["query"], str(r["day"])): (r["searches"], r["results"], r["fallback"]) for r in an.record_searches(searches, 2).collect()}
    assert log == {("blue lake", "2024-05-01"): (2, 5, "or"), ("qwzt", "2024-05-02"): (1, 0, "")}
    clicks = spark.createDataFrame(
        [("Blue Lake", "en", "2024-05-01 09:00:00", 4, 1, "result", "v1")] * 2 + [("blue lake", "en", "2024-05-01 09:01:00", 9, 2, "result", "v1"), ("a<b", "en", "2024-05-01 09:01:00", 9, 2, "result", "v2")],
        "query string, lang string, ts string, post_id long, rank int, source string, view string",
    )
    pins = spark.createDataFrame([("blue lake", 4)], "norm string, doc_id long")
    assert sorted((r["query"], r["post_id"], r["source"]) for r in an.read_clicks(clicks, pins).collect()) == [("blue lake", 4, "pinned"), ("blue lake", 9, "result")]


def test_late_events_and_compaction(spark, tmp_path):
    schema = "query string, lang string, ts timestamp, results long, fallback string"
    raw = str(tmp_path / "raw")

    def arrive(rows):
        spark.createDataFrame(rows, "query string, lang string, ts string, results long, fallback string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(raw)
        sl.run_counters(spark.readStream.schema(schema).parquet(raw), str(tmp_path / "log"))

    arrive([("a", "en", "2024-05-01 08:00:00", 3, ""), ("a", "en", "2024-05-01 09:00:00", 4, "")])
    arrive([("a", "en", "2024-05-01 08:30:00", 9, "or"), ("b", "en", "2020-01-01 08:30:00", 1, "")])
    want = {("a", 3, 4, ""), ("b", 1, 1, "")}
    assert {(r["query"], r["searches"], r["results"], r["fallback"]) for r in sl.latest(spark, str(tmp_path / "log")).collect()} == want
    sl.compact(spark, str(tmp_path / "log"), str(tmp_path / "less"))
    assert {(r["query"], r["searches"], r["results"], r["fallback"]) for r in sl.latest(spark, str(tmp_path / "less")).collect()} == want


def test_decoding_goes_on_until_nothing_is_encoded():
    text = "caf%C3%A9"
    for _ in range(120):
        text = text.replace("%", "%25")
    assert decode.decode_once_and_more(text)[0] == "café"
    assert decode.decode_once_and_more("50% off") == ("50% off", 0, True)
    assert decode.decode_once_and_more("caf%C3") == ("caf", 0, False)


def test_suggestions_and_related(spark):
    rows = [
        ("valmora", 33, 25, 2, "fr", ""), ("valmora", 6, 25, 20, "fr", ""), ("brume", 21, 14, 3, "fr", ""),
        ("méridie", 7, 9, 2, "fr", ""), ("meridie", 5, 9, 2, "fr", ""), ("seldom", 2, 11, 2, "fr", ""),
        ("nowhere", 28, 0, 2, "fr", ""), ("valmora nowhere", 13, 8, 2, "fr", "or"), ("few", 9, 4, 2, "fr", ""),
        ("long ago", 44, 19, 95, "fr", ""), ("y", 44, 19, 2, "fr", ""), ("fête des moulins", 7, 13, 370, "fr", ""),
        ("off season", 55, 13, 310, "fr", ""), ("river", 27, 11, 2, "en", ""), ("rude word", 11, 12, 2, "fr", ""),
    ]
    log = spark.createDataFrame(rows, "query string, searches long, results long, ago int, lang string, fallback string")
    log = log.withColumn("day", F.date_sub(F.lit("2023-09-10").cast("date"), F.col("ago")))
    found = an.suggestions(log, "2023-09-10").orderBy("lang", "place").collect()
    assert [r["query"] for r in found if r["lang"] == "fr"] == ["fête des moulins", "valmora", "brume", "rude word", "méridie"]
    assert [r["query"] for r in found if r["lang"] == "en"] == ["river"]
    blocked = an.suggestions(log, "2023-09-10", blocked=["rude"]).collect()
    assert "rude word" not in {r["query"] for r in blocked}
    asked = spark.createDataFrame([(1, "fr", "Valmora à pied"), (2, "fr", "avec")], "qid long, lang string, query string")
    assert [(r["qid"], r["query"]) for r in an.related(asked, log, "2023-09-10").collect()] == [(1, "valmora")]


def marks(spark, f, text, terms, lang="fr", prefixes=()):
    row = spark.createDataFrame([(text, list(terms), list(prefixes), lang)], "x string, t array<string>, p array<string>, l string")
    return row.select(f(*map(F.col, "xtpl")).alias("y")).first()["y"]


def test_highlights(spark):
    got = marks(spark, pr.highlight, 'À Méridie, <b> "meridies"', ["meridie"])
    assert got == 'À <mark class="search-highlight">Méridie</mark>, &lt;b&gt; &quot;meridies&quot;'
    assert marks(spark, pr.highlight, "Bäcker", ["baecker"], "de").startswith("<mark") and not marks(spark, pr.highlight, "Bäcker", ["baecker"]).startswith("<mark")
    assert marks(spark, pr.highlight, "Brumes", [], prefixes=["brum"]).startswith("<mark")
    page = '<p title="lac">lac &amp; &eacute;t&eacute;<script>lac</script><!-- lac --><title>lac</title></p>'
    marked = marks(spark, pr.highlight_html, page, ["lac"])
    assert marked.count("<mark") == 1 and 'title="lac"' in marked and "&amp; été" in marked
    with pytest.raises(ValueError):
        pr.highlight(F.lit(""), F.lit(""), F.lit(""), F.lit(""), "<b>")


def test_excerpts(spark):
    long = "Rien ici. " * 30 + "Une grotte et un moulin! " + "Fin du texte. " * 30
    rows = spark.createDataFrame(
        [
            (1, "fr", long, "", ["grotte", "moulin"], []), (2, "fr", "rien", "un résumé", ["grotte"], []), (3, "fr", "rien", "la grotte", ["grotte"], []),
            (4, "fr", None, None, ["grotte"], []), (5, "fr", "mot " * 200, "", ["grotte"], []), (6, "fr", "grotte\n\nmoulin", None, ["moulin"], ["grot"]),
        ],
        "doc_id long, lang string, content string, excerpt string, terms array<string>, prefixes array<string>",
    )
    got = {r["doc_id"]: (r["html"], r["source"], r["hits"]) for r in pr.excerpts(rows, 120).collect()}
    assert got[1][1:] == ("content", 2) and got[1][0].startswith("… Une <mark") and got[1][0].endswith(" …")
    assert got[2] == ("un résumé", "summary", 0) and got[3][1:] == ("excerpt", 1) and got[4] == ("", "summary", 0)
    assert got[5][0] == ("mot " * 30).strip() + " …" and got[5][1] == "summary"
    assert got[6] == ('<mark class="search-highlight">grotte</mark> <mark class="search-highlight">moulin</mark>', "content", 2)


def test_reasons_and_images(spark):
    names = "marked boolean, title string, terms array<string>, concepts array<string>, fields array<string>, lang string, guide array<string>, places array<string>, hubs array<string>, alts array<string>, pinned boolean, tags array<string>"
    base = (False, "Titre", ["brume"], [], [], "fr", [], [], [], [], False, [])
    cases = [(base[:4] + (["place"],) + base[5:7] + (["Ostland", "Brume"],) + base[8:], ("place", "Brume", "Ostland")), (base[:4] + (["taxonomy"],) + base[5:11] + (["la brume"],), ("tag", "la brume", None)),
             (base[:10] + (True, []), ("pinned", None, None)), ((True,) + base[1:], None), (base[:1] + ("Brume",) + base[2:10] + (True, []), None)]
    table = spark.createDataFrame([c[0] for c in cases], names)
    none = F.array().cast("array<struct<slug:string,label:string>>")
    args = [F.col(c.split()[0]) for c in names.split(", ")]
    got = table.select(pr.reason(*args[:10], none, *args[10:]).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in got] == [c[1] for c in cases]
    images = spark.createDataFrame([(1, 10, "lake", 0.4, True), (1, 11, "hill", 0.9, False), (2, 12, "hill", 0.9, False)], "doc_id long, image_id long, slug string, confidence double, featured boolean")
    results = spark.createDataFrame([(1, 1, ["hill"]), (2, 1, []), (3, 2, ["lake"])], "qid long, doc_id long, concepts array<string>")
    assert sorted((r["qid"], r["image_id"]) for r in pr.result_images(images, results).collect()) == [(1, 11), (2, 10)]


def test_html(spark):
    page = """<!-- search:skip --><p>skipped</p><!-- /search:skip --><h3 class="a">Le <i>vieux</i> moulin</h3><style>p {}</style>
    <div>Caf&eacute; &#38; th&#xE9;&nbsp;ici<br/>deux &bogus; x</div><p>[box a="1"] Lieu [nota] [side_note]dedans[/side_note]</p><!-- y --> 1 < 2"""
    text = one(spark, lambda c: ht.plain_text(ht.readable(c)), page)
    assert text.split("\n") == ["Le vieux moulin", "Café & thé ici", "deux &bogus; x", "Lieu [nota] dedans", "1 < 2"]
    assert one(spark, lambda c: ht.headings(ht.readable(c)), page) == ["Le vieux moulin"]


def test_index_plan_and_states(spark):
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "bad"), (5, "e", None)], "doc_id long, source_hash string, error string")
    old = spark.createDataFrame([(1, "a", "indexed"), (2, "x", "indexed"), (3, "c", "indexed"), (4, "d", "indexed")], "doc_id long, source_hash string, status string")
    plan = mt.index_plan(new, old)
    assert {r["doc_id"]: r["action"] for r in plan.collect()} == {1: "unchanged", 2: "indexed", 3: "failed", 4: "removed", 5: "indexed"}
    kept = mt.apply_plan(plan, new.select("doc_id", "source_hash"), old.select("doc_id", "source_hash"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (2, "b"), (3, "c"), (5, "e")]


def test_hubs_and_affected_posts(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "child long, hub long")
    hubs = spark.createDataFrame([(2,), (3,), (4,)], "hub long")
    found = {(r["doc_id"], r["hub"]): r["strength"] for r in ix.hub_closure(edges, hubs).collect()}
    assert found[1, 2] == 60 and found[1, 3] == 36 and (1, 4) not in found and found[2, 2] == 100
    images = spark.createDataFrame([(9, 7)], "doc_id long, image_id long")
    changed = spark.createDataFrame([("hub", 3), ("image", 7)], "kind string, id long")
    got = {r["doc_id"] for r in mt.affected_posts(changed, ix.hub_closure(edges, hubs), images).collect()}
    assert got == {1, 2, 3, 9}


def test_word_lists_are_folded():
    assert "ou" in tx.folded_list(lexicon.STOPWORDS["fr"]) and "fur" in tx.folded_list(lexicon.STOPWORDS["de"])
    assert ("fr", "londres", "london") in tx.synonym_rows() and ("fr", "randonnee", "rando") not in tx.synonym_rows()
