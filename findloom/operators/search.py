"""A search from query to page in one call, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..sources.storage import cut
from . import parse as ps
from . import present as pr
from . import rank as rk
from .cache import ranked_once
from .index import Index


@dataclass(frozen=True)
class Request:
    """How to search. ``query`` changes the raw query and ``hits`` the rows of a page, after excerpts; with ``keep``
    rankings are kept with the index and queries asked before are not ranked again (without ``labels`` only).
    ``reason`` changes the reason of a result."""

    page: int = 1
    per_page: int = 10
    guides: int = 0
    excerpts: bool = True
    explain: bool = False
    excerpt_chars: int = lx.EXCERPT_CHARS
    template: str = pr.TEMPLATE
    rank: rk.Options = field(default_factory=rk.Options)
    synonyms: list[tuple[str, str, str]] | None = None
    languages: tuple[str, ...] = tuple(lx.LANGUAGES)
    default_language: str = lx.LANGUAGES[0]
    query: Callable[[Column], Column] | None = None
    hits: Callable[[DataFrame], DataFrame] | None = None
    keep: bool = False
    reason: Callable[[Column], Column] | None = None


def resolve_language(lang: Column, languages: tuple[str, ...] | list[str], default: str) -> Column:
    """A known language code in lower case; the default for others and for null."""
    code = F.lower(F.trim(lang))
    return F.when(code.isin(*languages), code).otherwise(F.lit(default))


@dataclass(frozen=True)
class Answer:
    """``results`` (a page of each query), ``totals`` (a row per query), ``guides``, ``parsed`` and, if asked for,
    ``explain`` (words) and ``explain_whole`` (everything else)."""

    results: DataFrame
    totals: DataFrame
    guides: DataFrame
    parsed: DataFrame
    explain: DataFrame | None = None
    explain_whole: DataFrame | None = None


def image_alt_only(fields: Column) -> Column:
    """Whether only the words of a document's pictures matched, and none of its own."""
    return F.array_contains(fields, "alt") & ~F.arrays_overlap(fields, F.array(*map(F.lit, ("title", "content", "excerpt", "heading"))))


def _with_reason(page: DataFrame, signals: DataFrame, request: Request) -> tuple[DataFrame, list[str]]:
    """A page's rows with the signals of their documents and ``reason``, and the columns to show."""
    names = [c for c in signals.columns if c not in ("doc_id", "lang")]
    own = signals.select("doc_id", "lang", *(F.col(c).alias(f"__{c}") for c in names))
    page = page.join(own, ["doc_id", "lang"], "left")
    s = {c: F.coalesce(F.col(f"__{c}"), F.array().cast(signals.schema[c].dataType)) for c in names}
    marked = F.col("hits") > 0 if request.excerpts else F.lit(False)
    fields = F.coalesce("fields", F.array().cast("array<string>"))
    why = pr.reason(
        marked, F.coalesce("title", F.lit("")), F.col("matched_terms"), F.col("concepts"), fields, F.col("lang"), s["guide"], s["places"],
        s["hubs"], s["alts"], s["photo_concepts"], F.col("pinned"), s["tags"],
    )
    shown = {"reason": request.reason(why) if request.reason else why, "places": s["places"], "hubs": s["hubs"], "tags": s["tags"]}
    return page.withColumns(shown), list(shown)


def search(
    queries: DataFrame, index: Index, request: Request | None = None, pins: DataFrame | None = None, hubs: DataFrame | None = None,
    labels: DataFrame | None = None, signals: DataFrame | None = None,
) -> Answer:
    """``queries(qid, lang, query)`` answered over an index.

    ``pins`` are ``rank.read_pins``' rows, ``hubs(hub)`` documents that are
    guides, and ``labels(lang, slug, label)`` concepts. With ``signals``
    (``index.signals_of``) results have their documents' places, hubs and tags,
    and the reason why they are there where neither title nor excerpt shows it.
    Texts are read for the rows of the page only.
    """
    request = request or Request()
    options, size = request.rank, max(1, min(100, request.per_page))
    spark, terms, docs = queries.sparkSession, index.terms, index.docs
    lang = resolve_language(F.col("lang"), request.languages, request.default_language)
    raw = F.coalesce("query", F.lit(""))
    asked = queries.select("qid", lang.alias("lang"), (request.query(raw) if request.query else raw).alias("query"))
    q, qv = ps.parse(asked, options.stopwords, request.synonyms)
    if labels is not None:
        qv, _ = ps.attach_concepts(q, qv, labels)
    full = ps.expand_prefixes(qv, terms, index.vocabulary)
    kept = request.keep and labels is None
    found = ranked_once(q, qv, index, options, request.synonyms) if kept else rk.rank(q, full, terms, docs, options, index.positions)
    pins = spark.createDataFrame([], "line int, query string, doc_id long, pos int") if pins is None else pins
    ranked = rk.apply_pins(found["ranked"], q, pins, docs, options)
    hubs = spark.createDataFrame([], "hub long") if hubs is None else hubs
    split = cut(rk.split_guides(ranked, hubs, request.guides))
    listed = split.where("not guide").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place")))

    missing = found["missing"].groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "raw"))), lambda m: m["raw"]).alias("missing_words"))
    counts = listed.groupBy("qid").agg(F.count("*").alias("total"), F.max("fallback").alias("fallback"))
    totals = (
        q.select("qid", "lang", "query").join(counts, "qid", "left").join(missing, "qid", "left")
        .select(
            "qid", "lang", "query", F.coalesce("total", F.lit(0)).alias("total"),
            F.ceil(F.coalesce("total", F.lit(0)) / size).cast("int").alias("pages"), F.coalesce("fallback", F.lit("none")).alias("fallback"),
            F.coalesce("missing_words", F.array().cast("array<string>")).alias("missing_words"),
        )
    )
    first = (max(1, request.page) - 1) * size
    rows = listed.where(F.col("rank").between(first + 1, first + size))
    none = F.array().cast("array<string>")
    won = rk.matched_terms(full, terms, rows, options)
    marks = ps.highlight_sets(qv).select("qid", F.col("terms").alias("asked"), "prefixes")
    # The rows of the page are broadcast, if they are few, so that no text is shuffled to them.
    shown_here = F.broadcast(rows) if rows.count() <= rk.VARIANTS_MOST else rows
    texts = docs.select("doc_id", "lang", "title", "content", "excerpt")
    page = (
        shown_here.join(texts, ["doc_id", "lang"]).join(won, ["qid", "doc_id"], "left").join(marks, "qid", "left")
        .withColumn("matched_terms", F.coalesce("terms", none)).withColumn("concepts", F.coalesce("concepts", none))
        .withColumn("terms", F.array_union(F.coalesce("asked", none), "matched_terms")).withColumn("prefixes", F.coalesce("prefixes", none))
    )
    title = pr.highlight(F.col("title"), F.col("terms"), F.col("prefixes"), F.col("lang"), request.template)
    page = page.withColumn("title_html", title).withColumn("image_alt_only", F.coalesce(image_alt_only(F.col("fields")), F.lit(False)))
    shown = [
        "qid", "doc_id", "rank", "pinned", "score", "matched_terms", F.coalesce("fields", none).alias("matched_fields"),
        F.col("concepts").alias("matched_concepts"), "image_alt_only", "title_html",
    ]
    if request.excerpts:
        page = pr.excerpts(page.drop("source", "hits", "html"), request.excerpt_chars, request.template)
        shown += [F.col("html").alias("excerpt"), F.col("source").alias("excerpt_source")]
    if signals is not None:
        page, told = _with_reason(page, signals, request)
        shown += told
    results = page.select(*shown)
    guides = split.where("guide").select("qid", "doc_id", "score", "place")
    more = {}
    if request.explain:
        best = rk.contributions(full, terms, options, winners=True, results=rows)
        more = {"explain": rk.explain(best, found["groups"], options), "explain_whole": rk.explain_whole(rows)}
    return Answer(request.hits(results) if request.hits else results, totals, guides, q, **more)
