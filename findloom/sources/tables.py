"""The engine's inputs made from plain tables of documents, pages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index as ix
from . import html as ht
from .storage import new_folder, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts, for work on all cores."""
    return spread(table(spark, folder, name))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as posts: first line as title, source as tag, labelled quality as boost, a date by id."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(good, "doc_id", "left").select(
        "doc_id", "lang", F.lit("post").alias("post_type"),
        F.left(F.substring_index("text", "\n", 1), F.lit(80)).alias("title"),
        F.col("text").alias("content"), F.lit("").alias("excerpt"), F.col("source").alias("tag"),
        F.when(F.col("quality") == 1, 1.15).otherwise(1.0).alias("boost"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("post_date"),
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    """A place chain per document, continent and country, from ``nation`` and ``region`` by the document's id."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", (F.col("doc_id") % 25).alias("n_nationkey"))
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    named = docs.join(nation, "n_nationkey").join(region, nation["n_regionkey"] == region["r_regionkey"])
    chain = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("continent").alias("level"), F.col("r_name").alias("name")),
        F.struct(F.lit(1).alias("pos"), F.lit("country").alias("level"), F.col("n_name").alias("name")),
    )
    return named.select("doc_id", "lang", F.inline(chain), F.lit(None).cast("string").alias("tag"))


FIELDS = ["title", "content", "taxonomy", "place"]  # that documents have


def indexed(posts: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(terms, docs)`` of posts and the places of them."""
    rows = ix.field_rows(posts, {"title": "title", "content": "content", "taxonomy": "tag"}, ix.place_rows(places))
    return ix.build_terms(rows, fields=FIELDS), ix.build_docs(posts)


def build_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(terms, docs)`` of the documents, computed anew."""
    return indexed(posts(spark, folder), places(spark, folder))


def wide_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all fields of the documents: beside ``build_index``' ones an excerpt (the second line), the headings of
    the page of the same number, pictures and own fields (parts), guides (nations), hubs above, and concepts (sources)."""
    p, docs = posts(spark, folder), table(spark, folder, "documents")
    part, pages, nation = (table(spark, folder, name) for name in ("part", "pages", "nation"))
    i, own = F.col("doc_id"), docs.select("doc_id", "lang")
    second = F.split_part("content", F.lit("\n"), F.lit(2))
    rows = ix.field_rows(p, {"title": "title", "content": "content", "taxonomy": "tag", "excerpt": second}, ix.place_rows(places(spark, folder)))
    headings = F.array_join(ht.headings(ht.readable(F.col("html"))), "|")
    named = [
        ("heading", spread(pages).select(F.col("page_id").alias("doc_id"), headings.alias("name"))),
        ("alt", part.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("name"))),
        ("custom", part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))),
        ("guide", own.where(i % 4 == 0).join(nation, F.col("n_nationkey") == i % 25).select("doc_id", F.col("n_name").alias("name"))),
    ]
    for field, names in named:
        rows = rows.unionByName(ix.named_rows(own.join(names, "doc_id"), field))
    edges = docs.where(i % 3 != 0).select(i.alias("child"), F.floor(i / 7).alias("hub"))
    closure = ix.hub_closure(edges, docs.where(i % 2 == 0).select(i.alias("hub")))
    concepts = docs.select("doc_id", "lang", F.col("source").alias("slug"), (F.col("n_chars") % 100 / 100).alias("confidence"))
    return rows.unionByName(ix.hub_rows(closure, p)).unionByName(ix.concept_rows(concepts))


_BUILT: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, folder: str) -> ix.Index:
    """The documents' index, published once per application and read from Parquet."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        path = new_folder(spark, "index")
        ix.publish_index(*build_index(spark, folder), path, ix.rules_version(), fields=FIELDS)
        _BUILT[key] = path
    return ix.read_index(spark, _BUILT[key])


def benchmark_queries(spark: SparkSession, folder: str, quotes: bool = False) -> DataFrame:
    """One to three first words of each ``benchmark`` text, asked in four languages; some in quotes."""
    found = tx.words(F.col("text"))
    text = F.array_join(F.slice(found, F.lit(1), (F.col("item_id") % 3 + 1).cast("int")), " ")
    if quotes:
        text = F.when(F.col("item_id") % 5 == 1, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    langs = F.array(*map(F.lit, ["de", "en", "es", "fr"]))
    return table(spark, folder, "benchmark").select(
        "item_id", text.alias("query"), F.posexplode(langs).alias("k", "lang")
    ).select((F.col("item_id") * 4 + F.col("k")).cast("long").alias("qid"), "lang", "query")


def _event_fields() -> list:
    k = F.regexp_extract("props", "[0-9]+", 0)
    lang = F.get(F.array(F.lit("fr"), F.lit("en"), F.lit("de")), (F.col("user_id") % 3).cast("int"))
    return [F.concat(F.lit("q"), k).alias("query"), lang.alias("lang"), "ts"]


def search_events(events: DataFrame) -> DataFrame:
    """``view`` events as searches."""
    return events.where("event_type = 'view'").select(
        *_event_fields(), F.floor("value").cast("long").alias("results"),
        F.when(F.col("event_id") % 50 == 0, "or").otherwise("").alias("fallback"),
    )


def click_events(events: DataFrame, *more: Column) -> DataFrame:
    """``click`` events as clicks, with ``more`` columns of the events."""
    source = F.get(F.array(*map(F.lit, ["result", "pinned", "photos", "other"])), (F.col("event_id") % 4).cast("int"))
    return events.where("event_type = 'click'").select(
        *_event_fields(), F.col("user_id").alias("post_id"), (F.lit(1) + F.col("event_id") % 10).alias("rank"),
        source.alias("source"), *more,
    )
