"""Rankings kept by version of the index: a query asked again is not ranked again.

A ranking lies under the index' version and a hash of the options, and is found
by its language and query as cleaned. Queries without results are known, too. A
new version has rankings of its own, so none has to be called invalid.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..sources.storage import stored
from . import parse as ps
from . import rank as rk
from .index import Index

_FRAMES = ("ranked", "missing", "modes", "groups")


def options_key(options: rk.Options, synonyms: list[tuple[str, str, str]] | None = None) -> str | None:
    """A hash of what a ranking depends on besides index and query; none if that includes functions of the caller's."""
    if options.score or options.results:
        return None
    weights = {f: options.weight(f) for f in sorted({*lx.WEIGHTS, *options.weights})}
    told = [weights, options.post_types, options.fallback, options.stopwords, synonyms]
    return hashlib.md5(json.dumps(told, sort_keys=True, default=list).encode()).hexdigest()


def _read(index: Index, folder: str, name: str) -> DataFrame | None:
    try:
        return index.docs.sparkSession.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ranked_once(
    q: DataFrame, qv: DataFrame, index: Index, options: rk.Options | None = None, synonyms: list[tuple[str, str, str]] | None = None
) -> dict[str, DataFrame]:
    """``rank.rank`` of parsed queries, of which only those are ranked that the index' version does not have yet.

    Prefixes are looked up here, for those queries. Each batch of new rankings
    is a folder; its queries are listed after it is whole, so a batch that
    breaks off is ranked again. Frames with functions in ``options`` are not kept.
    """
    options = options or rk.Options()
    name = options_key(options, synonyms)
    if name is None or index.path is None:
        return rk.rank(q, ps.expand_prefixes(qv, index.terms, index.vocabulary), index.terms, index.docs, options, index.positions)
    folder = f"{index.path}/rankings/{index.number}-{name}"
    keyed = stored(q.select("qid", F.md5(F.concat_ws("\x00", "lang", "query")).alias("key")), "asked")
    asked = keyed.groupBy("key").agg(F.min("qid").alias("qid"))
    known = _read(index, folder, "known")
    new = stored(asked if known is None else asked.join(known, "key", "left_anti"), "new")
    if not new.isEmpty():
        mine = lambda df: df.join(new.select("qid"), "qid", "left_semi")
        full = ps.expand_prefixes(mine(qv), index.terms, index.vocabulary)
        found = rk.rank(mine(q), full, index.terms, index.docs, options, index.positions)
        batch = uuid.uuid4().hex
        for frame in _FRAMES:
            found[frame].join(new, "qid").drop("qid").write.parquet(f"{folder}/{frame}/batch={batch}")
        new.select("key", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{folder}/known")
        known = _read(index, folder, "known")
    batches = keyed.select("qid", "key").join(known.groupBy("key").agg(F.min("batch").alias("batch")), "key")
    return {frame: batches.join(_read(index, folder, frame), ["key", "batch"]).drop("key", "batch") for frame in _FRAMES}
