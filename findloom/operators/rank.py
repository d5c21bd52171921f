"""Ranking many queries at once over the inverted index.

One join of variants with terms, then aggregates: by (query, document, word)
for the best contribution of each field, by (query, word) for rarity, by query
for AND or the controlled OR, by (query, document) for the score. Document
texts are joined only for the candidates whose text is looked at.

Sums run over words in query order and fields in their fixed order, so scores
do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.storage import stored
from .index import bucket_of


@dataclass(frozen=True)
class Options:
    """``score`` changes the score of a row, ``(score, doc_id) -> score``; ``results`` changes or drops rows of the
    ranking ``(qid, doc_id, score, ...)``, which is sorted again after it."""

    weights: dict[str, float] = field(default_factory=dict)
    post_types: tuple[str, ...] | None = None
    fallback: bool = True
    stopwords: dict[str, list[str]] | None = None
    score: Callable[[Column, Column], Column] | None = None
    results: Callable[[DataFrame], DataFrame] | None = None

    def of_type(self, docs: DataFrame) -> DataFrame:
        """Indexed documents of the wanted types; none given means all."""
        live = docs.where("status = 'indexed'") if "status" in docs.columns else docs
        return live.where(F.col("post_type").isin(*self.post_types)) if self.post_types else live

    def weight(self, name: str) -> float:
        return max(0.0, float((lx.WEIGHTS | self.weights)[name]))


def amount(name: str, value: Column) -> Column:
    """How much a field's value counts: strength in percent, or a damped count."""
    return value / 100 if name in lx.STRENGTH_FIELDS else F.lit(1.0) + F.lit(0.6) * F.ln(value)


def rarity(docs: Column, df: Column) -> Column:
    top = F.greatest(F.ln(F.lit(2.0)), F.ln(F.lit(1.0) + docs / 5))
    raw = F.ln(F.lit(1.0) + docs / df) / top
    return F.when(df > 0, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.2))).otherwise(F.lit(0.0))


VARIANTS_MOST = 2_000_000  # rows of asked variants that are broadcast at most


def _bucketed(asked: DataFrame, table: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """``asked`` with the bucket of ``table`` that each row is in, if it has buckets, to be broadcast if its rows are few;
    and the keys to join both by."""
    if "bucket" in table.columns:
        asked, keys = asked.withColumn("bucket", bucket_of(table.schema["bucket"].metadata["buckets"])), [*keys, "bucket"]
    asked = stored(asked, name)
    few = asked.count() <= VARIANTS_MOST
    # A condition, without which Spark expects no pruning.
    return (F.broadcast(asked.where("term <> ''")) if few else asked), keys


def probe(qv: DataFrame, terms: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of ``terms`` that the variants ask for, one per variant.

    The variants are broadcast if they are few, so that the index is neither
    shuffled nor broadcast, and of an index in buckets only those are read that
    the variants name: Spark prunes folders by the broadcast, when it runs.
    More variants than that are dealt out with the buckets' rows they ask for.
    """
    asked = qv.select("qid", "lang", "g", "term", "weight", "kind").where("weight > 0")
    asked, keys = _bucketed(asked, terms, ["lang", "term"], "variants")
    return terms.select("doc_id", *keys, *fields).join(asked, keys).drop("bucket")


def phrases_in(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """``rows(qid, doc_id, lang, wanted)``, each with the normalized phrases to look for in a document, to
    ``(qid, doc_id, found)``: those that it has.

    The places of each word, moved back by the word's place in the phrase, meet
    where the phrase begins. Only the rows' documents and words are looked up.
    """
    phrases = rows.select("qid", "doc_id", "lang", F.explode("wanted").alias("phrase"))
    split = phrases.withColumn("words", F.split("phrase", " "))
    words = split.select("qid", "doc_id", "lang", "phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    asked, keys = _bucketed(words, positions, ["lang", "term", "doc_id"], "phrases")
    begins = F.transform("at", lambda place: place - F.col("offset"))
    starts = positions.join(asked, keys).select("qid", "doc_id", "phrase", "n", F.explode(begins).alias("start"))
    whole = starts.groupBy("qid", "doc_id", "phrase", "n", "start").agg(F.count("*").alias("met")).where("met = n")
    return whole.groupBy("qid", "doc_id").agg(F.collect_set("phrase").alias("found"))


def phrases_of(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``phrases_in`` by ``texts(doc_id, lang, content, excerpt)``: the texts that rows ask for, and no others, are
    normalized and looked through once for the phrases of all their queries. The rows are broadcast, if they are few, so
    that no text is shuffled."""
    asked = stored(rows.select("qid", "doc_id", "lang", F.explode("wanted").alias("phrase")), "phrases")
    few = asked.count() <= VARIANTS_MOST
    by_doc = asked.groupBy("doc_id", "lang").agg(F.collect_set("phrase").alias("wanted"))
    body = tx.normalize(F.concat_ws("\n", F.coalesce("content", F.lit("")), F.coalesce("excerpt", F.lit(""))))
    bodies = texts.join(F.broadcast(by_doc) if few else by_doc, ["doc_id", "lang"]).select("doc_id", "lang", "wanted", body.alias("body"))
    held = bodies.select("doc_id", "lang", "body", F.explode("wanted").alias("phrase")).where(tx.has_phrase(F.col("body"), F.col("phrase")))
    return asked.join(held.select("doc_id", "lang", "phrase").distinct(), ["doc_id", "lang", "phrase"]).groupBy("qid", "doc_id").agg(
        F.collect_set("phrase").alias("found")
    )


def contributions(
    qv: DataFrame, terms: DataFrame, options: Options, winners: bool = False, results: DataFrame | None = None
) -> DataFrame:
    """``(qid, lang, doc_id, g, <fields>)``: the best contribution of any variant, null where there is none.

    With ``winners`` also ``w_<field>``, the variant that gave it. Fields of
    weight 0, and those that the index does not have, are not read. ``results(qid, doc_id)`` restricts what is returned.
    """
    wanted = [f for f in lx.FIELDS if options.weight(f) > 0]
    fields = [f for f in wanted if f in terms.columns]
    if not fields:
        fields, terms = wanted[:1], terms.withColumns({f: F.lit(0) for f in wanted[:1]})
    hits = probe(qv, terms, fields)
    hits = hits if results is None else hits.join(results.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    points = {
        f: F.when(F.col(f) > 0, F.lit(options.weight(f)) * amount(f, F.col(f).cast("double")) * F.col("weight"))
        for f in fields
    }
    best = [F.max(p).alias(f) for f, p in points.items()]
    if winners:
        for f, p in points.items():
            # Of equal contributions the heavier variant wins, then the first term.
            won = F.struct((-p).alias("p"), (-F.col("weight")).alias("w"), "term", "kind", F.col(f).alias("value"))
            best.append(F.min(F.when(p.isNotNull(), won)).alias(f"w_{f}"))
    found = hits.groupBy("qid", "lang", "doc_id", "g").agg(*best)
    return found.where(F.coalesce(*fields).isNotNull())


def rank(
    q: DataFrame, qv: DataFrame, terms: DataFrame, docs: DataFrame, options: Options | None = None, positions: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Frames ``ranked``, ``missing``, ``modes`` and ``groups`` (df and rarity).

    ``docs`` has ``doc_id, lang, post_type, title_norm, content, excerpt,
    boost, post_date`` and, optionally, ``status``. Phrases are looked up in an
    index' ``positions``, if it keeps them, else in the candidates' texts.
    """
    options = options or Options()
    best = stored(contributions(qv, terms, options), "best")  # of what follows, three aggregates read it
    live = docs.where("status = 'indexed'") if "status" in docs.columns else docs
    counts = live.groupBy("lang").agg(F.count("*").alias("n_docs"))
    df = best.groupBy("qid", "g").agg(F.count("*").alias("df"))
    groups = qv.select("qid", "lang", "g", "raw").distinct()
    rare = (
        groups.join(df, ["qid", "g"], "left").join(counts, "lang", "left")
        .select(
            "qid", "g", "raw", F.coalesce("df", F.lit(0)).alias("df"),
            rarity(F.greatest(F.coalesce("n_docs", F.lit(0)), F.lit(1)).cast("double"), F.coalesce("df", F.lit(0)).cast("double")).alias("rarity"),
        )
    )
    points = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in best.columns[4:]), F.lit(0.0))
    title = F.col("title").isNotNull() if "title" in best.columns else F.lit(False)
    guide = F.col("guide").isNotNull() if "guide" in best.columns else F.lit(False)
    # Fields as bits and a column of points per word: of fixed size, so that rows are neither sorted nor made objects.
    bits = {f: 1 << i for i, f in enumerate(sorted(best.columns[4:]))}
    held = sum((F.when(F.col(f).isNotNull(), bit).otherwise(0) for f, bit in bits.items()), F.lit(0))
    parts = [f"part_{g}" for g in range(lx.MAX_GROUPS)]
    scored = (
        best.withColumn("points", points).withColumn("title_hit", title).withColumn("guide_hit", guide)
        .withColumn("hit_fields", held)
        .join(rare.select("qid", "g", "rarity"), ["qid", "g"])
        .groupBy("qid", "lang", "doc_id")
        .agg(
            F.count("*").cast("int").alias("matched"),
            *(F.max(F.when(F.col("g") == g, F.col("points") * F.col("rarity"))).alias(part) for g, part in enumerate(parts)),
            F.bool_and("title_hit").alias("titled"),
            F.bool_and(F.col("title_hit") | F.col("guide_hit")).alias("guided"),
            F.bit_or("hit_fields").alias("hit_fields"),
        )
        .withColumn("fields", F.array_compact(F.array(*(F.when(F.col("hit_fields").bitwiseAND(bit) > 0, F.lit(f)) for f, bit in bits.items()))))
        .withColumn("base", sum((F.coalesce(part, F.lit(0.0)) for part in parts), F.lit(0.0))).drop("hit_fields", *parts)
    )
    n = F.col("n_groups")
    reached = scored.groupBy("qid").agg(F.max("matched").alias("reached"))
    modes = q.select("qid", "n_groups").join(reached, "qid", "left").select(
        "qid", "n_groups",
        F.when(F.coalesce("reached", F.lit(0)) >= n, "none")
        .when(F.lit(options.fallback) & (n > 1) & (F.col("reached") >= F.when(n >= 3, F.ceil(n / 2)).otherwise(1)), "or")
        .otherwise("none").alias("fallback"),
        F.when(F.coalesce("reached", F.lit(0)) >= n, n)
        .when(F.lit(options.fallback) & (n > 1), F.when(n >= 3, F.ceil(n / 2)).otherwise(1))
        .otherwise(n).cast("int").alias("required"),
    )
    kept = scored.join(modes, "qid").where(F.col("matched") >= F.col("required"))
    live = options.of_type(docs)
    meta = live.select("doc_id", "lang", "title_norm", F.col("boost").cast("double").alias("boost"), "post_date")
    kept = kept.join(meta, ["doc_id", "lang"]).join(q.select("qid", "normalized", "tokens", "phrases"), "qid")
    coverage = F.col("matched") / n
    part = F.when(F.col("fallback") == "or", coverage * coverage).otherwise(1.0)
    score = F.col("base") * part
    lang, title_norm = F.col("lang"), F.col("title_norm")
    plain = tx.without_stopwords(F.col("tokens"), lang, options.stopwords)
    plain_title = tx.without_stopwords(F.split("title_norm", " "), lang, options.stopwords)
    multi = F.size("tokens") >= 2
    exact = (title_norm != "") & ((title_norm == F.col("normalized")) | ((plain != "") & (plain_title == plain)))
    in_title = multi & tx.has_phrase(title_norm, F.col("normalized"))
    bonus = F.when(exact, options.weight("title_exact")).when(in_title, options.weight("title_phrase")).otherwise(0.0)
    all_titled = F.when((n >= 2) & (F.col("matched") == n) & F.col("titled"), options.weight("title_all")).otherwise(0.0)
    kept = kept.withColumn("part", part).withColumn("title_bonus", bonus).withColumn("all_titled", all_titled)
    kept = kept.withColumn("score", score + F.col("title_bonus") + F.col("all_titled")).withColumn("phrase", F.lit(0.0))
    kept = stored(kept, "candidates")

    # The phrase in the text: for the best candidates only, whose text is joined now. They are taken by a limit, so a task
    # hands on no more of a query than that; the others are those behind the last of them.
    is_quoted = F.size("phrases") > 0
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    limit = F.when(is_quoted, lx.QUOTED_CANDIDATES).otherwise(lx.PHRASE_CANDIDATES)
    first = kept.where(is_quoted | multi).withColumn("at", F.row_number().over(by_score))
    first = first.where(F.col("at") <= max(lx.QUOTED_CANDIDATES, lx.PHRASE_CANDIDATES)).where(F.col("at") <= limit).drop("at")
    behind = F.struct(F.negative("score").alias("score"), "doc_id")
    last = first.groupBy("qid").agg(F.max(behind).alias("last"))
    wanted = F.array_distinct(F.concat("phrases", F.when(multi, F.array("normalized")).otherwise(F.array().cast("array<string>"))))
    if positions is None:
        found = phrases_of(first.select("qid", "doc_id", "lang", wanted.alias("wanted")), live.select("doc_id", "lang", "content", "excerpt"))
    else:
        found = phrases_in(first.select("qid", "doc_id", "lang", wanted.alias("wanted")), positions)
    near = first.join(found.withColumnRenamed("found", "body"), ["qid", "doc_id"], "left")
    holds = lambda p: F.coalesce(F.array_contains("body", p), F.lit(False))
    near = near.where(F.forall("phrases", lambda p: tx.has_phrase(F.col("title_norm"), p) | holds(p)))
    phrase = F.when(multi & holds(F.col("normalized")), options.weight("content_phrase"))
    near = near.withColumn("phrase", F.coalesce(phrase, F.lit(0.0))).withColumn("score", F.col("score") + F.col("phrase"))
    far = kept.where(~is_quoted).join(last, "qid", "left").where(F.col("last").isNull() | (behind > F.col("last"))).drop("last")
    boosted = F.col("score") * F.col("boost")
    boosted = options.score(boosted, F.col("doc_id")) if options.score else boosted
    final = near.drop("body").unionByName(far).withColumn("score", boosted).where("score > 0")
    final = final.withColumn("score", rounded(F.col("score")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("post_date"), F.desc("doc_id"))
    ranked = (
        final.withColumn("place", F.row_number().over(order)).where(F.col("place") <= lx.MAX_RESULTS)
        .select(
            "qid", "lang", "doc_id", "place", "score", "post_date", "fallback", "matched", "fields",
            ((F.col("matched") == n) & F.col("guided")).alias("about"), "n_groups", "part", "title_bonus", "all_titled", "phrase", "boost",
        )
    )
    if options.results:
        changed = options.results(ranked).withColumn("score", rounded(F.col("score")))
        ranked = changed.withColumn("place", F.row_number().over(order))
    missing = rare.where("df = 0").select("qid", "g", "raw")
    return {"ranked": ranked, "missing": missing, "modes": modes, "groups": rare}


def matched_terms(qv: DataFrame, terms: DataFrame, results: DataFrame, options: Options | None = None) -> DataFrame:
    """``(qid, doc_id, terms, concepts)`` of ``results(qid, doc_id)``: the variants that won in some field."""
    options = options or Options()
    best = contributions(qv, terms, options, winners=True, results=results)
    won = F.array_compact(F.array(*(F.col(f"w_{f}.term") for f in lx.FIELDS if f"w_{f}" in best.columns)))
    found = best.groupBy("qid", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(won)))).alias("all"))
    concept = lambda t: t.startswith("#")
    return found.select(
        "qid", "doc_id", F.filter("all", lambda t: ~concept(t)).alias("terms"),
        F.transform(F.filter("all", concept), lambda t: F.substring(t, 2, 1000)).alias("concepts"),
    )


def rounded(score: Column) -> Column:
    """Two decimals; what binary fractions leave just below a half is rounded up like the half it stands for."""
    return F.round(score.cast("decimal(18,6)"), 2).cast("double")


def explain(best: DataFrame, groups: DataFrame, options: Options | None = None) -> DataFrame:
    """``(qid, doc_id, g, field, term, kind, value, points)`` of ``contributions(..., winners=True)``."""
    options = options or Options()
    fields = [f for f in lx.FIELDS if f"w_{f}" in best.columns]
    rows = best.select(
        "qid", "doc_id", "g",
        F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("gain"), F.col(f"w_{f}").alias("won")) for f in fields))),
    ).where("gain is not null")
    return rows.join(groups.select("qid", "g", "rarity"), ["qid", "g"]).select(
        "qid", "doc_id", "g", "field", "won.term", "won.kind", "won.value", rounded(F.col("gain") * F.col("rarity")).alias("points"),
    )


def explain_whole(ranked: DataFrame) -> DataFrame:
    """``(qid, doc_id, what, factor, points)`` of what moves a document beyond its words: a partial match, the title,
    the phrase in the text, its boost and, in ``apply_pins``' results, a best bet."""
    none = F.lit(None).cast("double")
    row = lambda when, what, factor, points: F.when(
        when, F.struct(F.lit(what).alias("what"), factor.alias("factor"), points.alias("points"))
    )
    plus = lambda name, what: row(F.col(name) > 0, what, none, F.col(name).cast("double"))
    rows = [
        row(F.col("fallback") == "or", "partial match", F.col("part"), none), plus("title_bonus", "title"),
        plus("all_titled", "every word in the title"), plus("phrase", "phrase in the text"),
        row(F.col("boost") != 1, "document boost", F.col("boost"), none),
    ]
    if "pinned" in ranked.columns:
        rows.append(row(F.col("pinned"), "best bet", none, none))
    return ranked.select("qid", "doc_id", F.inline(F.array_compact(F.array(*rows))))


def read_pins(lines: DataFrame) -> DataFrame:
    """``lines(line, text)``, each like ``query = 12, 7``, to ``(line, query, norm, doc_id, pos)``: the documents pinned
    for a query, in written order. Lines without a query or a number are left out."""
    split = lines.where(F.contains("text", F.lit("=")))
    query = tx.clean(F.regexp_extract("text", r"^([^=]*)=", 1))
    ids = F.transform(F.regexp_extract_all(F.regexp_extract("text", r"(?s)=(.*)$", 1), F.lit(r"(?<![^\s,;])-?([0-9]{1,18})"), 1), lambda i: i.cast("long"))
    named = split.select("line", query.alias("query"), F.array_distinct(F.filter(ids, lambda i: i > 0)).alias("ids"))
    named = named.withColumn("norm", tx.normalize(F.col("query"))).where("norm <> ''")
    return named.select("line", "query", "norm", F.posexplode("ids").alias("pos", "doc_id"))


def apply_pins(
    ranked: DataFrame, q: DataFrame, pins: DataFrame, docs: DataFrame, options: Options | None = None
) -> DataFrame:
    """``pins(line, query, doc_id, pos)`` before the ranking, in written order, for identical normalized queries.

    A pin outside the language, the index or the wanted types is dropped; one
    that the ranking did not find has score 0. Where only pins remain there is
    no fallback any more. Adds ``pinned`` and renumbers ``place``.
    """
    wanted = q.where("normalized <> ''").join(pins.withColumn("normalized", tx.normalize(F.col("query"))).drop("query"), "normalized")
    able = (options or Options()).of_type(docs).select("doc_id", "lang")
    first = wanted.join(able, ["doc_id", "lang"], "left_semi").groupBy("qid", "lang", "doc_id").agg(F.min(F.struct("line", "pos")).alias("pin"))
    both = ranked.join(first, ["qid", "lang", "doc_id"], "full_outer")
    order = Window.partitionBy("qid").orderBy(F.col("pin").isNull(), "pin", "place")
    others = F.count_if(F.col("pin").isNull()).over(Window.partitionBy("qid")) > 0
    known = {
        "place": F.row_number().over(order), "score": F.coalesce("score", F.lit(0.0)), "about": F.coalesce("about", F.lit(False)),
        "fallback": F.when(others, F.coalesce("fallback", F.lit("none"))).otherwise("none"),
    }
    return both.select(*(known[c].alias(c) if c in known else c for c in ranked.columns), F.col("pin").isNotNull().alias("pinned"))


def split_guides(results: DataFrame, hubs: DataFrame, most: int) -> DataFrame:
    """Adds ``guide``: the first ``most`` results about the whole query that are hubs or matched a guide place.

    Not for pinned results or after a fallback, and never all of a query's results.
    """
    able = (
        F.col("about") & ~F.col("pinned") & (F.col("fallback") == "none")
        & (F.coalesce("is_hub", F.lit(False)) | F.coalesce(F.array_contains("fields", "guide"), F.lit(False)))
    )
    marked = results.join(hubs.select(F.col("hub").alias("doc_id"), F.lit(True).alias("is_hub")), "doc_id", "left")
    marked = marked.withColumn("able", able)
    order = Window.partitionBy("qid", "able").orderBy("place")
    cut = marked.withColumn("guide", F.col("able") & (F.row_number().over(order) <= most))
    everyone = Window.partitionBy("qid")
    spare = F.count_if(~F.col("guide")).over(everyone) > 0
    return cut.withColumn("guide", F.col("guide") & spare).drop("able", "is_hub")


def page(results: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """One page of each query's results, by ``place``."""
    size, number = max(1, min(100, size)), max(1, number)
    return results.where(F.col("place").between((number - 1) * size + 1, number * size))
