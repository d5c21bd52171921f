"""Index freshness: what is current, stale, failed, missing or orphaned, and what to do about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..sources.storage import stored
from .index import Index, add_segment, read_index


def eligible(posts: DataFrame, noindex: DataFrame, post_types: list[str]) -> DataFrame:
    """Published posts of the given types that are not excluded."""
    fine = posts.where((F.col("post_status") == "publish") & F.col("post_type").isin(*post_types))
    return fine.join(noindex.select("doc_id").distinct(), "doc_id", "left_anti")


def states(posts: DataFrame, docs: DataFrame, rules: str) -> DataFrame:
    """``posts(doc_id, modified)`` and ``docs(doc_id, status, post_modified, rules_version)`` to ``(doc_id, state)``.

    A post is ``current``, ``stale`` (changed, or indexed under other rules),
    ``failed`` or ``missing``; a document without post is an ``orphan``.
    """
    both = posts.select("doc_id", "modified", F.lit(True).alias("post")).join(
        docs.select("doc_id", "status", "post_modified", "rules_version", F.lit(True).alias("doc")), "doc_id", "full_outer"
    )
    fresh = F.col("post_modified").eqNullSafe(F.col("modified")) & (F.col("rules_version") == rules)
    state = (
        F.when(F.col("post").isNull(), "orphan").when(F.col("doc").isNull(), "missing")
        .when(F.col("status") == "failed", "failed").when(fresh, "current").otherwise("stale")
    )
    return both.select("doc_id", state.alias("state"))


def status_summary(found: DataFrame) -> DataFrame:
    """One row of counts by state."""
    names = ["current", "stale", "failed", "missing", "orphan"]
    eligible_ = F.count_if(F.col("state") != "orphan").alias("eligible")
    return found.agg(eligible_, *(F.count_if(F.col("state") == n).alias(n) for n in names))


def to_rebuild(found: DataFrame) -> DataFrame:
    """Ids to look at again, ascending: stale, failed, missing and orphaned ones."""
    return found.where("state <> 'current'").select("doc_id").distinct().orderBy("doc_id")


def index_plan(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new(doc_id, source_hash, error)`` against ``old(doc_id, source_hash, status)``: the action per document.

    ``removed``, ``failed`` (the old terms stay), ``unchanged`` or ``indexed``.
    """
    both = new.select("doc_id", F.col("source_hash").alias("h"), "error", F.lit(True).alias("now")).join(
        old.select("doc_id", F.col("source_hash").alias("was"), "status", F.lit(True).alias("before")), "doc_id", "full_outer"
    )
    action = (
        F.when(F.col("now").isNull(), "removed").when(F.col("error").isNotNull(), "failed")
        .when(F.col("before") & (F.col("h") == F.col("was")) & (F.col("status") == "indexed"), "unchanged").otherwise("indexed")
    )
    return both.select("doc_id", action.alias("action"))


def apply_plan(plan: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` for indexed documents and of ``old`` for unchanged and failed ones."""
    keep = plan.where("action in ('unchanged', 'failed')").select("doc_id")
    fresh = plan.where("action = 'indexed'").select("doc_id")
    return old.join(keep, "doc_id", "left_semi").unionByName(new.join(fresh, "doc_id", "left_semi"))


def refresh(index: Index, terms: DataFrame, docs: DataFrame, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A new build against a published index: ``(plan, terms, docs)`` of the version to publish.

    ``errors(doc_id, error)`` lists documents that could not be read: they keep
    their old terms and are marked as failed. Documents that are gone, and terms
    without a document, go.
    """
    none = docs.sparkSession.createDataFrame([], "doc_id long, error string")
    errors = none if errors is None else errors
    old = index.docs.withColumn("status", F.lit("indexed")) if "status" not in index.docs.columns else index.docs
    new = docs.select("doc_id", "source_hash").join(errors, "doc_id", "full_outer").select("doc_id", "source_hash", "error")
    plan = stored(index_plan(new, old.select("doc_id", "source_hash", "status")), "plan")
    kept = apply_plan(plan, docs.withColumn("status", F.lit("indexed")), old.select(*(c for c in docs.columns if c != "status"), "status"))
    failed = plan.where("action = 'failed'").select("doc_id", F.lit(True).alias("failed"))
    marked = kept.join(failed, "doc_id", "left").withColumn("status", F.when(F.col("failed"), "failed").otherwise(F.col("status")))
    return plan, apply_plan(plan, terms, index.terms.select(terms.columns)), marked.drop("failed")


def refresh_published(
    spark: SparkSession, path: str, docs: DataFrame, terms_of: Callable[[DataFrame], DataFrame], errors: DataFrame | None = None,
    rules: str | None = None,
) -> DataFrame:
    """A published index brought up to date with ``docs`` (``index.build_docs``' rows of all posts) by one more segment.

    Only documents that ``index_plan`` finds new or changed are indexed again:
    ``terms_of(docs)`` makes their terms. Documents that are gone are hidden,
    and those with ``errors(doc_id, error)`` keep their terms, marked as failed.
    Other ``rules`` than the index has index everything again. Gives the plan.
    """
    index = read_index(spark, path)
    none = spark.createDataFrame([], "doc_id long, error string")
    new = docs.select("doc_id", "source_hash").join(none if errors is None else errors, "doc_id", "full_outer").select("doc_id", "source_hash", "error")
    old = index.docs.select("doc_id", "source_hash", "status")
    if rules is not None and rules != index.rules:
        old = old.withColumn("source_hash", F.lit(None).cast("string"))
    plan = stored(index_plan(new, old), "plan")
    named = lambda action: plan.where(F.col("action") == action).select("doc_id")
    fresh = docs.join(named("indexed"), "doc_id", "left_semi").withColumn("status", F.lit("indexed")).select(index.docs.columns)
    failed = index.docs.join(named("failed"), "doc_id", "left_semi").withColumn("status", F.lit("failed"))
    add_segment(spark, path, terms_of(fresh), fresh.unionByName(failed), named("removed"), named("failed"), rules)
    return plan


def orphan_terms(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """Terms whose document is not there."""
    return terms.join(docs.select("doc_id"), "doc_id", "left_anti")


def failures(docs: DataFrame) -> DataFrame:
    """Documents marked as failed."""
    return docs.where("status = 'failed'")


def whole_summary(found: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: counts by state, the index' sizes, and documents by language."""
    by_lang = docs.groupBy("lang").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("by_lang"))
    return status_summary(found).join(index_stats(terms), F.lit(True)).join(by_lang, F.lit(True))  # a row each


def index_stats(terms: DataFrame) -> DataFrame:
    """Rows, distinct terms, and rows per field."""
    return terms.agg(
        F.count("*").alias("rows"), F.count_distinct("term").alias("terms"),
        *(F.count_if(F.col(f) > 0 if f in terms.columns else F.lit(False)).alias(f"in_{f}") for f in lx.FIELDS),
    )


def affected_posts(changed: DataFrame, closure: DataFrame, images: DataFrame) -> DataFrame:
    """``changed(kind, id)`` (post, hub or image) to the posts to index again."""
    kind = lambda k: changed.where(F.col("kind") == k).select("id")
    posts = kind("post").select(F.col("id").alias("doc_id"))
    members = closure.join(kind("hub").withColumnRenamed("id", "hub"), "hub", "left_semi").select("doc_id")
    users = images.join(kind("image").withColumnRenamed("id", "image_id"), "image_id", "left_semi").select("doc_id")
    hubs = kind("hub").select(F.col("id").alias("doc_id"))
    return posts.union(hubs).union(members).union(users).distinct()
