"""The search log and clicks as streams: daily counters kept up to date from raw events.

A batch of events becomes increments of daily counters, however late its events
are. Increments are added up when counters are read, and ``compact`` turns many
into one. What a day's cap on new queries has to remember, the queries that a
day has already, is a table by day, of as many rows a day as the cap; a batch
reads the days that it has events of. Clicks wait for a search of their query
in the state of a join of both streams, which forgets days that are over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import analytics as an
from ..sources.storage import stored

_KEYS = ["query", "lang", "day"]


def increments(events: DataFrame) -> DataFrame:
    """``events(query, lang, ts, results, fallback)`` to ``(query, lang, day, searches, last)``."""
    last = F.max(F.struct("ts", "results", "fallback"))
    return events.groupBy("query", "lang", F.to_date("ts").alias("day")).agg(F.count("*").alias("searches"), last.alias("last"))


def _feed(events: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_counters(events: DataFrame, folder: str, read: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Feed all that is available into ``folder``. ``read`` makes counted searches of raw ones (as
    ``analytics.read_searches`` does). A batch that is run again replaces its own files, so each counts once."""

    def add(batch: DataFrame, number: int) -> None:
        counted = read(batch) if read else batch
        increments(counted).write.mode("overwrite").parquet(f"{folder}/increments/n={number}")

    _feed(events, folder, add)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEYS).agg(F.sum("searches").alias("searches"), F.max("last").alias("last"))


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """All increments that no compaction holds, with the compaction itself; and the last batch's number."""
    rows = spark.read.option("basePath", f"{folder}/increments").parquet(f"{folder}/increments/*")
    last = rows.agg(F.max("n")).first()[0]
    return rows, -1 if last is None else last


def compact(spark: SparkSession, folder: str, into: str) -> int:
    """The counters of all batches so far as one batch's increments in the folder ``into``, whose later batches go
    there too; gives the number of the last one."""
    rows, last = _files(spark, folder)
    _added(rows.drop("n")).write.mode("overwrite").parquet(f"{into}/increments/n={last}")
    return last


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The counters as of the last batch."""
    return _added(_files(spark, folder)[0].drop("n")).select(
        *_KEYS, "searches", F.col("last.results").alias("results"), F.col("last.fallback").alias("fallback")
    )


_KEPT = "query string, lang string, day date, n long"


def _admitted(rows: DataFrame, folder: str, number: int, cap: int) -> DataFrame:
    """``rows(query, lang, day, seen, ...)`` of a batch whose query the day has already or still has room for, those
    searched first coming first. Queries that are new to a day are noted."""
    spark = rows.sparkSession
    first_day = rows.agg(F.min("day")).first()[0]
    if number == 0 or first_day is None:
        known = spark.createDataFrame([], _KEPT)
    else:
        # Of batches before this one only: a batch that is run again finds what it found at first.
        known = spark.read.schema(_KEPT).option("basePath", f"{folder}/kept").parquet(f"{folder}/kept")
        known = known.where((F.col("n") < number) & (F.col("day") >= F.lit(first_day)))
    known = known.select(*_KEYS).distinct()
    full = known.groupBy("day").agg(F.count("*").alias("taken"))
    order = Window.partitionBy("day").orderBy("seen", "query", "lang")
    new = rows.join(known, _KEYS, "left_anti").select(*_KEYS, "seen").withColumn("at", F.row_number().over(order)).where(F.col("at") <= cap)
    new = stored(new.join(full, "day", "left").where(F.col("at") + F.coalesce("taken", F.lit(0)) <= cap).select(*_KEYS), "new")
    new.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/kept/n={number}")
    return rows.join(known.union(new), _KEYS, "left_semi")


def run_recorder(searches: DataFrame, folder: str, daily_cap: int = lx.MAX_NEW_PER_DAY) -> None:
    """Feed raw searches into ``folder`` as ``analytics.record_searches`` would: no junk, log keys, ``daily_cap`` new
    queries a day (0: any number), in the order in which batches bring them."""

    def add(batch: DataFrame, number: int) -> None:
        counted, probes = an.read_searches(batch)
        counted = counted.withColumn("fallback", F.when(F.col("fallback") == "none", "").otherwise(F.col("fallback")))
        last = F.max(F.struct("ts", "results", "fallback")).alias("last")
        rows = counted.groupBy("query", "lang", F.to_date("ts").alias("day")).agg(F.count("*").alias("searches"), last, F.min("ts").alias("seen"))
        if daily_cap > 0:
            rows = _admitted(stored(rows, "batch"), folder, number, daily_cap)
        rows.drop("seen").write.mode("overwrite").parquet(f"{folder}/increments/n={number}")
        probes.write.mode("overwrite").parquet(f"{folder}/probes/n={number}")

    _feed(searches, folder, add)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The log that ``run_recorder`` keeps, without the empty rows of words that probes were glued to."""
    probes = spark.read.schema("word string, lang string, day date, n long").option("basePath", f"{folder}/probes").parquet(f"{folder}/probes")
    return an.forget_baselines(latest(spark, folder), probes.select("word", "lang", "day"))


def distinct_clicks(clicks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of ``clicks(view, source, post_id, ts, ...)`` with a view's first click on each post and source only;
    clicks without a view all stay."""
    timed = clicks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    once = timed.where("view is not null").dropDuplicatesWithinWatermark(["view", "source", "post_id"])
    return timed.where("view is null").unionByName(once)


def searched_clicks(clicks: DataFrame, searches: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of ``clicks(query, lang, ts, ...)`` that a search of the stream ``searches(query, lang, ts)`` answers:
    for the same query and language, on the day of the click or the day before, whichever comes first.

    Of searches a day's first one of each query is kept. Both sides are
    forgotten once their watermarks have left those two days behind.
    """
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("searched")
    days = searches.select(F.col("query").alias("__query"), F.col("lang").alias("__lang"), day).withWatermark("searched", lateness)
    days = days.dropDuplicatesWithinWatermark(["__query", "__lang", "searched"])
    timed = clicks if _has_watermark(clicks) else clicks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    near = (F.col("ts") >= F.col("searched")) & (F.col("ts") < F.col("searched") + F.expr("interval 2 days"))
    same = (F.col("query") == F.col("__query")) & (F.col("lang") == F.col("__lang"))
    return timed.join(days, same & near, "left_semi")


def _has_watermark(stream: DataFrame) -> bool:
    """Whether ``distinct_clicks`` or the caller has set one on ``ts``."""
    return "spark.watermarkDelayMs" in stream.schema["ts"].metadata


def run_clicks(
    clicks: DataFrame, folder: str, valid: Callable[[DataFrame], DataFrame], searches: DataFrame | None = None, lateness: str = "1 day"
) -> None:
    """Feed a click stream into ``folder``; ``valid`` keeps the clicks of a batch that count (``analytics.valid_clicks``,
    or ``possible_clicks`` where the stream of ``searches`` decides whether there was one). With a ``view`` column a
    view's repeated clicks count once."""

    def add(batch: DataFrame, number: int) -> None:
        valid(batch).write.mode("overwrite").parquet(f"{folder}/clicks/n={number}")

    once = distinct_clicks(clicks, lateness) if "view" in clicks.columns else clicks
    _feed(once if searches is None else searched_clicks(once, searches, lateness), folder, add)


def counted_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The click counters of all batches so far."""
    return an.click_counts(spark.read.option("basePath", f"{folder}/clicks").parquet(f"{folder}/clicks/*").drop("n"))


def run_changes(changes: DataFrame, folder: str, index_again: Callable[[DataFrame], None], affected: Callable[[DataFrame], DataFrame]) -> None:
    """Feed a stream of ``changes(kind, id)``: each batch's affected posts, once each, go to ``index_again``."""
    _feed(changes, folder, lambda batch, _: index_again(affected(batch.distinct())))
