"""One query per operator over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import cache as ch
from ..operators import index as ix
from ..operators import maintain as mt
from ..operators import parse as ps
from ..operators import present as pr
from ..operators import rank as rk
from ..operators import recover as rc
from ..operators import search as sr
from ..sources import html as ht
from ..sources import tables as tb
from ..sources.storage import new_folder
from ..streaming import log as sl
from . import oracle

AS_OF = oracle.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return tb.table(spark, d, "documents")


def _texts(spark, d):
    return tb.wide_table(spark, d, "documents")


# --- text and index ---------------------------------------------------------


@_query
def token_counts(spark, d):
    rows = _texts(spark, d).select("doc_id", "lang", F.explode(tx.words(tx.fold(F.col("text")))).alias("term"))
    return rows.groupBy("doc_id", "lang", "term").agg(F.count("*").alias("tf"))


@_query
def fold_distinct(spark, d):
    return _texts(spark, d).agg(
        F.count_distinct(tx.fold(F.col("text"))).alias("folded"), F.count_distinct(F.lower("text")).alias("lowered")
    )


@_query
def terms_wide(spark, d):
    return tb.build_index(spark, d)[0].select("doc_id", "lang", "term", "title", "content", "taxonomy", "place")


@_query
def terms_all_fields(spark, d):
    """The terms of documents with all eleven fields."""
    return ix.build_terms(tb.wide_rows(spark, d)).select("doc_id", "lang", "term", *lx.FIELDS)


@_query
def term_df(spark, d):
    terms = tb.build_index(spark, d)[0]
    return terms.groupBy("lang", "term").agg(F.count("*").alias("df"), F.sum("content").alias("occurrences"))


@_query
def stopword_filtered(spark, d):
    rows = _texts(spark, d).select("lang", F.explode(tx.words(tx.fold(F.col("text")))).alias("term"))
    kept = F.count_if(tx.indexable(F.col("term"), F.col("lang")))
    return rows.groupBy("lang").agg(F.count("*").alias("words"), kept.alias("kept"))


@_query
def german_forms(spark, d):
    rows = _texts(spark, d).where("lang = 'de'").select(F.explode(tx.words(F.col("text"))).alias("raw")).distinct()
    found = rows.select("raw", tx.fold(F.col("raw")).alias("norm"), tx.german(F.col("raw")).alias("spelled"))
    return found.where("spelled <> norm")


@_query
def place_strength(spark, d):
    return ix.place_rows(tb.places(spark, d)).select("doc_id", F.col("text").alias("name"), "strength")


@_query
def hub_closure(spark, d):
    docs = _docs(spark, d)
    edges = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 7).alias("hub"))
    return ix.hub_closure(edges, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("hub")))


@_query
def image_concepts(spark, d):
    images = _docs(spark, d).select(
        (F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("image_id"), F.col("source").alias("slug"),
        F.col("lang").alias("label"), (F.col("n_chars") % 100 / 100).alias("confidence"),
    )
    return ix.image_concepts(images)


@_query
def html_text(spark, d):
    return tb.wide_table(spark, d, "pages").select("page_id", ht.plain_text(ht.readable(F.col("html"))).alias("text"))


@_query
def html_headings(spark, d):
    found = F.array_join(ht.headings(ht.readable(F.col("html"))), "|")
    return tb.wide_table(spark, d, "pages").select("page_id", found.alias("headings"))


# --- queries ----------------------------------------------------------------


def _parsed(spark, d, quotes=False):
    return ps.parse(tb.benchmark_queries(spark, d, quotes))


@_query
def parsed_queries(spark, d):
    q, _ = _parsed(spark, d, True)
    return q.select(
        "qid", "normalized", F.size("tokens").alias("n_tokens"), "n_groups", F.array_join("phrases", "|").alias("phrases")
    )


@_query
def query_variants(spark, d):
    return _parsed(spark, d, True)[1].select("qid", "g", "raw", "term", "weight", "kind")


@_query
def prefix_expand(spark, d):
    at = tb.index(spark, d)
    qv = ps.expand_prefixes(_parsed(spark, d, True)[1], at.terms, at.vocabulary)
    return qv.where("kind = 'prefix'").select("qid", "g", "term", "weight")


@_query
def concept_exact(spark, d):
    q, qv = _parsed(spark, d, True)
    labels = qv.where("g = 0").select("lang", F.col("token").alias("slug"), F.col("token").alias("label")).distinct()
    qv, found = ps.attach_concepts(q, qv, labels)
    return ps.exact_concepts(q, qv, found)


# --- ranking ----------------------------------------------------------------


def _rank(spark, d, quotes=False, **options):
    at = tb.index(spark, d)
    q, qv = _parsed(spark, d, quotes)
    return rk.rank(q, ps.expand_prefixes(qv, at.terms, at.vocabulary), at.terms, at.docs, rk.Options(**options), at.positions), q, at.docs


@_query
def rank_and(spark, d):
    return _rank(spark, d, fallback=False)[0]["ranked"].select("qid", "doc_id", "score", "place")


@_query
def rank_or(spark, d):
    ranked = _rank(spark, d)[0]["ranked"]
    return ranked.select("qid", "doc_id", "score", "place", "fallback", "matched", "about")


@_query
def rank_twice(spark, d):
    """``rank_or`` from kept rankings: half of the queries are asked first, then all, then all again."""
    at, (q, qv) = tb.index(spark, d), _parsed(spark, d)
    half = lambda df: df.where("qid % 2 = 0")
    for asked in ((half(q), half(qv)), (q, qv)):
        ch.ranked_once(*asked, at)
    return ch.ranked_once(q, qv, at)["ranked"].select("qid", "doc_id", "score", "place", "fallback", "matched", "about")


@_query
def rank_phrase(spark, d):
    return _rank(spark, d, quotes=True)[0]["ranked"].select("qid", "doc_id", "score", "place")


@_query
def missing_words(spark, d):
    return _rank(spark, d)[0]["missing"]


@_query
def word_rarity(spark, d):
    return _rank(spark, d)[0]["groups"].select("qid", "g", "df", F.round("rarity", 6).alias("rarity"))


@_query
def page_two(spark, d):
    return rk.page(_rank(spark, d)[0]["ranked"], 2, 10).select("qid", "doc_id", "place")


@_query
def rank_pins(spark, d):
    found, q, docs = _rank(spark, d)
    keyed = q.where("qid % 3 = 0").select("lang", F.col("normalized").alias("query"), (F.col("qid") % 40).alias("key"))
    ids = docs.select("doc_id", "lang", (F.col("doc_id") % 40).alias("key"))
    pins = keyed.join(ids, ["lang", "key"]).select(F.lit(0).alias("line"), "query", "doc_id", F.col("doc_id").alias("pos"))
    out = rk.apply_pins(found["ranked"], q, pins.distinct(), docs)
    return out.select("qid", "doc_id", "score", "pinned", "place")


@_query
def rank_guides(spark, d):
    found, _, docs = _rank(spark, d)
    hubs = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("hub"))
    out = rk.split_guides(found["ranked"].withColumn("pinned", F.lit(False)), hubs, 3)
    return out.select("qid", "doc_id", "place", "guide")


@_query
def rank_explain(spark, d):
    at = tb.index(spark, d)
    q, qv = _parsed(spark, d)
    qv = ps.expand_prefixes(qv, at.terms, at.vocabulary)
    groups = rk.rank(q, qv, at.terms, at.docs)["groups"]
    return rk.explain(rk.contributions(qv, at.terms, rk.Options(), winners=True), groups)


@_query
def explain_whole(spark, d):
    ranked = _rank(spark, d, quotes=True)[0]["ranked"]
    return rk.explain_whole(ranked).withColumn("factor", F.round("factor", 6))


def _pin_lines(spark, d):
    """Best-bet lines for every third query: two documents each, and lines that are none."""
    q = tb.benchmark_queries(spark, d).where("qid % 12 = 0").select(F.col("qid").alias("line"), "query", (F.col("qid") % 40).alias("k"))
    text = F.concat("query", F.lit(" = "), (F.col("k") + 1).cast("string"), F.lit(", "), F.col("k").cast("string"), F.lit("; 0 x7"))
    return q.select("line", F.explode(F.array(text, F.lit("no line"), F.lit("= 3"))).alias("text"))


@_query
def pin_lines(spark, d):
    return rk.read_pins(_pin_lines(spark, d))


def _search(spark, d, **request):
    pins = rk.read_pins(_pin_lines(spark, d)).drop("norm")
    hubs = _docs(spark, d).where("doc_id % 4 = 0").select(F.col("doc_id").alias("hub"))
    asked = tb.benchmark_queries(spark, d, True)
    request = sr.Request(languages=("de", "en", "es", "fr"), guides=3, **request)
    return sr.search(asked, tb.index(spark, d), request, pins, hubs)


@_query
def search_page(spark, d):
    """The second page of every query: pins first, guides apart, partial matches where nothing has all words."""
    return _search(spark, d, page=2, excerpts=False).results.select("qid", "doc_id", "rank", "pinned", "score", "image_alt_only")


@_query
def search_totals(spark, d):
    found = _search(spark, d, excerpts=False).totals
    return found.select("qid", "total", "pages", "fallback", F.array_join("missing_words", "|").alias("missing_words"))


@_query
def search_guides(spark, d):
    return _search(spark, d, excerpts=False).guides.select("qid", "doc_id", "score")


@_query
def search_results(spark, d):
    """The first page of every query with titles, excerpts and what matched."""
    return _search(spark, d).results


def _page(spark, d):
    """The first page of every query with its documents and what to mark in them."""
    at = tb.index(spark, d)
    q, qv = _parsed(spark, d)
    ranked = rk.rank(q, ps.expand_prefixes(qv, at.terms, at.vocabulary), at.terms, at.docs)["ranked"]
    marks = ps.highlight_sets(qv)
    return rk.page(ranked, 1, 10).select("qid", "lang", "doc_id", "place").join(marks, "qid").join(at.docs, ["doc_id", "lang"])


@_query
def excerpts(spark, d):
    """The first page of every query with its excerpt; texts are joined for those rows only."""
    return pr.excerpts(_page(spark, d)).select("qid", "doc_id", "place", "html", "source", "hits")


@_query
def highlights(spark, d):
    marked = pr.highlight(F.col("title"), F.col("terms"), F.col("prefixes"), F.col("lang"))
    return _page(spark, d).select("qid", "doc_id", marked.alias("html"))


@_query
def highlight_sets(spark, d):
    found = ps.highlight_sets(_parsed(spark, d, True)[1])
    return found.select("qid", F.array_join("terms", "|").alias("terms"), F.array_join("prefixes", "|").alias("prefixes"))


# --- recovery ---------------------------------------------------------------


@_query
def fuzzy_closest(spark, d):
    """The nearest terms of every term of five to nine letters with its third letter left out."""
    known = tb.index(spark, d).vocabulary
    broken = F.concat(F.left("term", F.lit(2)), F.substring("term", 4, 100))
    asked = known.where("length(term) between 5 and 9").select("lang", broken.alias("token")).distinct()
    return rc.closest_terms(asked, tb.index(spark, d).terms, known, tb.index(spark, d).deletions)


@_query
def did_you_mean(spark, d):
    at = tb.index(spark, d)
    asked = tb.benchmark_queries(spark, d).select(
        "qid", "lang", F.concat(F.left("query", F.lit(3)), F.substring("query", 5, 200)).alias("query")
    )
    return rc.did_you_mean(asked, at.terms, at.docs, vocabulary=at.vocabulary, deletions=at.deletions)


@_query
def other_languages(spark, d):
    at = tb.index(spark, d)
    return rc.other_languages(tb.benchmark_queries(spark, d), at.terms, at.docs, ["de", "en", "es", "fr"], vocabulary=at.vocabulary)


@_query
def path_results(spark, d):
    """The best documents for the words of paths, made of the queries."""
    at = tb.index(spark, d)
    url = F.concat(F.lit("https://x.example/en/"), F.replace("query", F.lit(" "), F.lit("-")), F.lit(".html"))
    asked = tb.benchmark_queries(spark, d).where("lang = 'en'").select("qid", "lang", url.alias("url"))
    return rc.for_path(asked, at.terms, at.docs, vocabulary=at.vocabulary)


@_query
def path_query(spark, d):
    return rc.path_words(tb.table(spark, d, "pages"), "url").select("page_id", "words")


# --- log and clicks ---------------------------------------------------------


def _log(spark, d):
    return an.log_counts(tb.search_events(tb.table(spark, d, "events")))


def _clicks(spark, d):
    raw = tb.click_events(tb.table(spark, d, "events"))
    return an.click_counts(an.valid_clicks(raw, _docs(spark, d), _log(spark, d)))


@_query
def log_counts(spark, d):
    return _log(spark, d)


def _is_file(spark, path) -> bool:
    """Whether a table is one file, asked through Spark's own reader."""
    row = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).first()
    return row is not None and row["file"].rstrip("/").endswith("/events.parquet")


@_query
def stream_log_counts(spark, d):
    events = tb.table(spark, d, "events")
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4)
    # A stream reads folders; the table may be one file in its folder.
    live = files.option("pathGlobFilter", "events.parquet").parquet(d) if _is_file(spark, f"{d}/events.parquet") else files.parquet(f"{d}/events.parquet")
    folder = new_folder(spark, "stream")
    sl.run_counters(tb.search_events(live), folder)
    return sl.latest(spark, folder)


def _live_events(spark, d):
    """``events`` as a stream that brings them in order of time, in four batches."""
    events = tb.table(spark, d, "events")
    folder = new_folder(spark, "arriving")
    marks = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)
    at, bounds = F.unix_micros(F.col("ts").cast("timestamp")), [None, *marks, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = (at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True))
        events.where(inside).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@_query
def stream_recorded_log(spark, d):
    """``recorded_log`` from a stream of several batches."""
    folder = new_folder(spark, "stream")
    sl.run_recorder(_raw_searches_of(_live_events(spark, d)), folder, 40)
    return sl.recorded(spark, folder)


@_query
def stream_click_counts(spark, d):
    """``click_counts`` from a stream of clicks that meets a stream of searches."""
    folder = new_folder(spark, "stream")
    live = _live_events(spark, d)
    docs = _docs(spark, d)
    sl.run_clicks(tb.click_events(live), folder, lambda batch: an.possible_clicks(batch, docs), tb.search_events(live))
    return sl.counted_clicks(spark, folder)


@_query
def view_clicks(spark, d):
    """Clicks of page views, every third of which has no name: those all count, the others once a post and source."""
    events = tb.table(spark, d, "events")
    view = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("v"), (F.col("event_id") % 9).cast("string")))
    read = an.read_clicks(tb.click_events(events, view.alias("view")))
    return read.groupBy("source", F.col("view").isNull().alias("nameless")).agg(F.count("*").alias("clicks"))


@_query
def click_counts(spark, d):
    return _clicks(spark, d)


@_query
def log_top(spark, d):
    return an.log_report(_log(spark, d), AS_OF, "top")


def _thin_log(spark, d):
    """A log in which every fifth query finds nothing and the next one little."""
    k = F.substring("query", 2, 10).cast("int") % 5
    few = F.when(k == 0, 0).when(k == 1, F.col("results") % 4).otherwise(F.col("results"))
    return _log(spark, d).withColumn("results", few)


@_query
def log_zero(spark, d):
    return an.log_report(_thin_log(spark, d), AS_OF, "zero")


@_query
def log_low(spark, d):
    return an.log_report(_thin_log(spark, d), AS_OF, "low")


@_query
def log_fallback(spark, d):
    return an.log_report(_log(spark, d), AS_OF, "fallback")


@_query
def log_by_lang(spark, d):
    return an.by_language(_log(spark, d), AS_OF)


@_query
def clicks_report(spark, d):
    return an.click_report(_clicks(spark, d), _log(spark, d), AS_OF)


@_query
def clicks_unclicked(spark, d):
    return an.unclicked(_log(spark, d), _clicks(spark, d), AS_OF)


@_query
def clicks_by_source(spark, d):
    return an.clicks_by_source(_clicks(spark, d), AS_OF)


@_query
def proven(spark, d):
    today = F.lit(AS_OF).cast("date")
    return an.proven(_log(spark, d), F.date_sub(today, lx.SUGGEST_DAYS), today)


@_query
def suggestions(spark, d):
    return an.suggestions(_log(spark, d), AS_OF)


@_query
def suggestions_blocked(spark, d):
    """Suggestions without the queries that a table of phrases names: every third, and some in other spellings."""
    log = _log(spark, d)
    k = F.substring("query", 2, 10).cast("int")
    phrases = log.where(k % 3 == 0).select(F.concat(F.lit(" "), F.upper("query"), F.when(k % 2 == 0, " nowhere").otherwise(" ")).alias("phrase"))
    return an.suggestions(log, AS_OF, blocked=phrases)


@_query
def suggestions_season(spark, d):
    """A year later only last year's season suggests anything."""
    return an.suggestions(_log(spark, d), oracle.NEXT_YEAR)


@_query
def related(spark, d):
    """Searches related to "q1 <query>" of each proven query."""
    log = _log(spark, d)
    mine = an.known_queries(log, AS_OF).select("lang", F.concat(F.lit("q1 "), "query").alias("query"))
    asked = mine.select(F.concat_ws(":", "lang", "query").alias("qid"), "lang", "query")
    return an.related(asked, log, AS_OF)


@_query
def daily_cap(spark, d):
    kept = an.capped_keys(tb.search_events(tb.table(spark, d, "events")), 40)
    return kept.groupBy("day").agg(F.count("*").alias("searches"))


def _raw_searches(spark, d):
    """Searches as they come in: every seventh with a probe glued to its word, every eleventh encoded."""
    return _raw_searches_of(tb.table(spark, d, "events"))


def _raw_searches_of(events):
    found = tb.search_events(events.select("*", F.col("event_id").alias("n"))).withColumn("results", F.when(F.col("results") % 3 == 0, 0).otherwise(F.col("results")))
    n = F.unix_seconds(F.col("ts").cast("timestamp"))
    word = F.concat(F.lit("word"), F.translate(F.right("query", F.lit(1)), "0123456789", "abcdefghij"))
    query = F.when(n % 7 == 0, F.concat(word, F.lit(")'(,,).)\"("))).when(n % 7 == 1, word).when(n % 11 == 0, F.concat(F.lit(" "), F.upper("query"), F.lit("%20x")))
    return found.withColumn("query", query.otherwise(F.col("query")))


@_query
def recorded_log(spark, d):
    """Raw searches to the log: no junk, cleaned keys, forty new keys a day, no baselines."""
    return an.record_searches(_raw_searches(spark, d), 40)


@_query
def baseline_forget(spark, d):
    counted, probes = an.read_searches(_raw_searches(spark, d))
    return an.forget_baselines(an.log_counts(counted), probes)


@_query
def recorded_clicks(spark, d):
    """Raw clicks, some on pins, under their log keys."""
    raw = tb.click_events(tb.table(spark, d, "events")).withColumn("query", F.upper("query"))
    pins = spark.createDataFrame([(f"q{i}", 7 * i + k) for i in range(100) for k in range(7)], "norm string, doc_id long")
    read = an.read_clicks(raw, pins)
    return read.groupBy("query", "lang", "source").agg(F.count("*").alias("clicks"))


@_query
def prune(spark, d):
    return an.prune(_log(spark, d), AS_OF, 7)


@_query
def purge(spark, d):
    """A log that was written without a junk filter, without what is junk."""
    raw = _raw_searches(spark, d)
    return an.purge_junk(an.log_counts(raw), _clicks(spark, d))[0]


@_query
def junk_filter(spark, d):
    text, item = F.col("text"), F.col("item_id").cast("string")
    asked = F.array(
        F.concat(F.left(text, F.lit(6)), F.lit("v%C3%A9lo")), F.concat(F.left(text, F.lit(6)), F.lit("v%25C3%25A9lo")), F.lit("bavi%C3"),
        F.left(text, F.lit(60)), F.left(text, F.lit(140)), F.concat(F.left(text, F.lit(10)), F.lit(")'(,,).)\"(")),
        F.concat(F.lit("sleep("), item, F.lit(")")), F.concat(F.lit("/fr-fr/"), item),
        F.concat(F.left(text, F.lit(8)), F.lit("\"a\" 'b'")), F.concat(F.lit("porto "), item),
    )
    rows = tb.table(spark, d, "benchmark").select("item_id", F.explode(asked).alias("query"))
    return an.with_junk(rows)


# --- maintenance ------------------------------------------------------------


def _states(spark, d):
    docs = _docs(spark, d)
    fresh = F.lit("2024-01-01 00:00:00").cast("timestamp")
    posts = docs.where("doc_id % 9 <> 0 and doc_id % 14 <> 0").select("doc_id", fresh.alias("modified"))
    changed = F.when(F.col("doc_id") % 6 == 0, F.lit("2023-01-01 00:00:00").cast("timestamp")).otherwise(fresh)
    state = F.when(F.col("doc_id") % 19 == 0, "failed").otherwise("indexed")
    indexed = docs.where("doc_id % 10 <> 3").select(
        "doc_id", state.alias("status"), changed.alias("post_modified"), F.lit("r1").alias("rules_version")
    )
    return mt.states(posts, indexed, "r1")


@_query
def status_summary(spark, d):
    return mt.status_summary(_states(spark, d))


@_query
def stale_ids(spark, d):
    return mt.to_rebuild(_states(spark, d))


@_query
def index_plan(spark, d):
    docs, i = _docs(spark, d), F.col("doc_id")
    new = docs.where("doc_id % 13 <> 0").select(
        "doc_id", F.when(i % 5 == 0, "new").otherwise("same").alias("source_hash"),
        F.when(i % 11 == 0, "unreadable").alias("error"),
    )
    old = docs.where("doc_id % 17 <> 0").select("doc_id", F.lit("same").alias("source_hash"), F.lit("indexed").alias("status"))
    return mt.index_plan(new, old)


@_query
def index_stats(spark, d):
    return mt.index_stats(tb.build_index(spark, d)[0]).select("rows", "terms", "in_title", "in_content", "in_taxonomy", "in_place")


@_query
def docs_per_lang(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("docs"))


@_query
def doc_terms(spark, d):
    """The title's terms of every document."""
    return tb.index(spark, d).terms.where("title > 0").select("doc_id", "term", "title")


@_query
def eligible_docs(spark, d):
    docs = _docs(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "draft").otherwise("publish").alias("post_status"),
        F.when(F.col("doc_id") % 3 == 0, "page").otherwise("post").alias("post_type"),
    )
    return mt.eligible(docs, docs.where("doc_id % 7 = 0").select("doc_id"), ["post"]).select("doc_id")


@_query
def affected_docs(spark, d):
    docs = _docs(spark, d)
    edges = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 7).alias("hub"))
    closure = ix.hub_closure(edges, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("hub")))
    images = docs.select("doc_id", (F.col("doc_id") % 50).alias("image_id"))
    kind = F.when(F.col("doc_id") % 3 == 0, "post").when(F.col("doc_id") % 3 == 1, "hub").otherwise("image")
    changed = docs.where("doc_id < 30").select(kind.alias("kind"), F.col("doc_id").alias("id"))
    return mt.affected_posts(changed, closure, images)


@_query
def place_tags(spark, d):
    """Tags that are no places."""
    docs = _docs(spark, d)
    tags = docs.select("doc_id", "lang", (F.col("doc_id") % 30).alias("tag_id"), F.col("source").alias("name"))
    return ix.taxonomy_rows(tags, docs.select("doc_id", (F.col("doc_id") % 20).alias("tag_id"))).select("doc_id", F.col("text").alias("name"))


@_query
def result_image(spark, d):
    docs = _docs(spark, d)
    images = docs.select(
        (F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("image_id"), F.col("source").alias("slug"),
        (F.col("n_chars") % 100 / 100).alias("confidence"), (F.col("doc_id") % 9 == 0).alias("featured"),
    )
    results = docs.where("doc_id < 50").select(F.col("doc_id").alias("qid"), "doc_id", F.array("source").alias("concepts"))
    return pr.result_images(images, results).select("doc_id", "image_id")


@_query
def refreshed(spark, d):
    """The actions of a build in which some documents changed, left, or could not be read."""
    at = tb.index(spark, d)
    docs = at.docs.where("doc_id % 13 <> 0").withColumn("source_hash", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("source_hash")))
    errors = docs.where("doc_id % 11 = 0").select("doc_id", F.lit("unreadable").alias("error"))
    plan, terms, _ = mt.refresh(at, at.terms.where("doc_id % 13 <> 0 and doc_id % 11 <> 0"), docs, errors)
    kept = terms.groupBy("doc_id").agg(F.count("*").alias("n_terms"))
    return plan.join(kept, "doc_id", "left").select("doc_id", "action", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def _in_steps(spark, d):
    """An index built in three steps: two thirds of the documents, some in an older form; the others and those anew;
    then some that left, and some that could not be read again."""
    p, places, path, i = tb.posts(spark, d), tb.places(spark, d), new_folder(spark, "steps"), F.col("doc_id")
    first, again = i % 3 != 0, (i % 3 == 0) | (i % 10 == 0)
    older = p.withColumn("title", F.when(i % 10 == 0, F.lit("an older title")).otherwise(F.col("title")))
    ix.publish_index(*tb.indexed(older.where(first), places.where(first)), path, "r1")
    ix.add_segment(spark, path, *tb.indexed(p.where(again), places.where(again)))
    failed = ix.read_index(spark, path).docs.where((i % 17 == 0) & (i % 13 != 0)).withColumn("status", F.lit("failed"))
    no_terms = ix.read_index(spark, path).terms.where("false")
    ix.add_segment(spark, path, no_terms, failed, p.where(i % 13 == 0).select("doc_id"), failed.select("doc_id"))
    return ix.read_index(spark, path)


@_query
def stats_in_steps(spark, d):
    """The counts by language of an index of three segments, added up from theirs."""
    fields = ["in_title", "in_content", "in_taxonomy", "in_place"]
    return ix.statistics(spark, _in_steps(spark, d).path).select("lang", "rows", "docs", *fields)


@_query
def indexed_in_steps(spark, d):
    """The terms of an index of three segments."""
    return _in_steps(spark, d).terms.select("doc_id", "lang", "term", "title", "content", "taxonomy", "place")


@_query
def words_in_steps(spark, d):
    """The vocabulary of an index of three segments: counts of each added up, those of hidden documents taken off."""
    return _in_steps(spark, d).vocabulary.select("lang", "term", "docs", "strong")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.all_sql().items() if name in QUERIES}
