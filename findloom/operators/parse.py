"""Queries to groups of words, and groups to weighted variants.

``queries(qid, lang, query)`` become

* ``q(qid, lang, query, normalized, tokens, n_groups, phrases)``, and
* ``qv(qid, lang, g, token, raw, term, weight, kind)``: the terms to look up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decode as dc
from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.storage import cut, stored


def parse(
    queries: DataFrame, stopwords: dict | None = None, synonyms: list[tuple[str, str, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(q, qv)`` with word, plural and synonym variants; the first of these kinds that makes a term wins.

    The words of the queries are computed at once and kept: they are small beside an index.
    """
    spark = queries.sparkSession
    read = dc.with_decoded(queries.select("qid", "lang", "query"), "query", "read")
    cleaned = read.select("qid", "lang", tx.clean(F.col("read.text")).alias("query"))
    lang = F.col("lang")
    found = cleaned.select("qid", "lang", F.posexplode(tx.words(F.col("query"))).alias("pos", "raw"))
    found = found.withColumn("token", tx.fold(F.col("raw"))).where(tx.indexable(F.col("token"), lang, stopwords))
    first = found.groupBy("qid", "lang", "token").agg(F.min(F.struct("pos", "raw")).alias("first"))
    order = Window.partitionBy("qid").orderBy("first.pos")
    groups = cut(
        first.withColumn("g", F.row_number().over(order) - 1).where(F.col("g") < lx.MAX_GROUPS)
        .select("qid", "lang", "g", "token", F.col("first.raw").alias("raw"))
    )
    sizes = groups.groupBy("qid").agg(F.count("*").cast("int").alias("n_groups"))
    q = cleaned.join(sizes, "qid", "left").select(
        "qid", "lang", "query", tx.normalize(F.col("query")).alias("normalized"),
        tx.tokens(F.col("query")).alias("tokens"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        tx.quoted(F.col("query")).alias("phrases"),
    )
    rows = tx.synonym_rows() if synonyms is None else synonyms
    pairs = spark.createDataFrame(rows or [("", "", "")], "lang string, token string, term string")
    keys = ["qid", "lang", "g", "token", "raw"]
    same = groups.select(*keys, F.explode(tx.forms(F.col("raw"), lang, stopwords)).alias("term"), F.lit(0).alias("prio"))
    less = groups.select(*keys, F.explode(tx.singulars(F.col("token"), lang)).alias("term"), F.lit(1).alias("prio"))
    other = groups.join(pairs, ["lang", "token"]).select(*keys, "term", F.lit(2).alias("prio"))
    best = same.union(less).union(other).groupBy(*keys, "term").agg(F.min("prio").alias("prio"))
    kinds = ["word", "plural", "synonym"]
    qv = best.select(
        *keys, "term", F.get(F.array(*(F.lit(lx.VARIANTS[k]) for k in kinds)), F.col("prio")).alias("weight"),
        F.get(F.array(*map(F.lit, kinds)), F.col("prio")).alias("kind"),
    )
    return q, qv


def expand_prefixes(qv: DataFrame, terms: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``qv`` with up to 30 longer terms of the index per word of four letters or more, in term order.

    An equi-join on language and the first four characters finds candidates;
    the cut to 30 comes before variants that exist already are left out.
    ``vocabulary`` (of the index) saves making one of all terms.
    """
    groups = qv.select("qid", "lang", "g", "token", "raw").distinct()
    able = groups.where((F.char_length("token") >= lx.MIN_PREFIX) & ~F.col("token").rlike("^[0-9]+$"))
    head = lambda c: F.left(F.col(c), F.lit(lx.MIN_PREFIX))
    if vocabulary is None:
        vocabulary = terms.select("lang", "term").distinct().withColumn("head", head("term"))
    longer = (
        able.withColumn("head", head("token")).join(vocabulary.select("lang", "head", "term"), ["lang", "head"])
        .where(F.col("term").startswith(F.col("token")) & (F.col("term") != F.col("token")))
    )
    order = Window.partitionBy("qid", "g").orderBy("term")
    capped = longer.withColumn("at", F.row_number().over(order)).where(F.col("at") <= lx.PREFIX_TERMS)
    new = capped.join(qv.select("qid", "g", "term"), ["qid", "g", "term"], "left_anti")
    longer_terms = new.select(*qv.columns[:5], "term", F.lit(lx.VARIANTS["prefix"]).alias("weight"), F.lit("prefix").alias("kind"))
    return stored(qv.unionByName(longer_terms), "variants")


def attach_concepts(
    q: DataFrame, qv: DataFrame, labels: DataFrame, matches: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Concepts named in queries as variants of the words that name them, and ``(qid, slug, confidence)``.

    ``labels(lang, slug, label)`` match as whole folded words: the runs of a
    query's words, up to the longest label's length, are joined with them.
    ``matches(qid, slug, confidence, matched)`` of an own matcher come first.
    """
    known = stored(labels.select("lang", "slug", tx.tokens(F.col("label")).alias("words")).where(F.size("words") > 0).distinct(), "labels")
    longest = known.agg(F.max(F.size("words"))).first()[0] or 1
    runs = q.select("qid", "lang", F.explode(tx.grams(F.col("normalized"), longest)).alias("gram"))
    named = runs.join(known.withColumn("gram", F.array_join("words", " ")), ["lang", "gram"]).select(
        "qid", "slug", F.lit(1.0).alias("confidence"), "words"
    )
    if matches is not None:
        own = matches.select("qid", "slug", "confidence", tx.tokens(F.col("matched")).alias("words"))
        named = own.unionByName(named.join(own, ["qid", "slug"], "left_anti"))
    groups = qv.select("qid", "lang", "g", "token", "raw").distinct()
    hit = groups.join(named, "qid").where(F.array_contains("words", F.col("token")))
    more = hit.select(
        "qid", "lang", "g", "token", "raw", F.concat(F.lit("#"), "slug").alias("term"),
        F.lit(lx.VARIANTS["concept"]).alias("weight"), F.lit("concept").alias("kind"),
    ).distinct()
    found = hit.groupBy("qid", "slug").agg(F.round(F.max("confidence"), 3).alias("confidence"))
    return qv.unionByName(more), found


def highlight_sets(qv: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """``(qid, terms, prefixes)``: what to mark in texts found by a query.

    The terms of its variants but for concepts, with ``matched(qid, terms)``
    those that ranking found, and its words that prefixes are looked up for.
    """
    word = F.when((F.char_length("token") >= lx.MIN_PREFIX) & ~F.col("token").rlike("^[0-9]+$"), F.col("token"))
    own = qv.groupBy("qid").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("word", "plural", "synonym"), F.col("term")))).alias("terms"),
        F.array_sort(F.collect_set(word)).alias("prefixes"),
    )
    if matched is None:
        return own
    more = matched.select("qid", F.explode("terms").alias("term")).where(~F.col("term").startswith("#"))
    found = more.groupBy("qid").agg(F.collect_set("term").alias("more"))
    both = F.array_sort(F.array_union("terms", F.coalesce("more", F.array().cast("array<string>"))))
    return own.join(found, "qid", "left").select("qid", both.alias("terms"), "prefixes")


def exact_concepts(q: DataFrame, qv: DataFrame, found: DataFrame) -> DataFrame:
    """``(qid, slug)``: the concept that covers all of a query's words; none for quoted phrases."""
    covered = qv.where("kind = 'concept'").groupBy("qid", F.substring("term", 2, 1000).alias("slug")).agg(
        F.count_distinct("g").alias("covered")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("covered"), F.desc("confidence"), "slug")
    best = covered.join(found, ["qid", "slug"]).withColumn("at", F.row_number().over(order)).where("at = 1")
    whole = q.where((F.size("phrases") == 0) & (F.col("n_groups") > 0))
    return best.join(whole, "qid").where("covered = n_groups").select("qid", "slug")
