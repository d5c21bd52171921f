"""URL filters: rules first, then templates of a path tree for each host.

Paths of a host form a tree of segments. Level by level, variable segments
become wildcards of their kind (a kind of segment under one node with many
distinct values for its rows), and sibling branches whose children look alike,
labelled or not, and whose labels, where they have some, agree, merge into one.
Each host and template then has a smoothed purity: of its labelled rows, the
share that is blocked. Rows that no rule judges are blocked where the template's
purity reaches ``PURITY``; a template without labels stays at the prior, and so
is allowed.

Scale: the tree is over distinct paths with their counts. Every level costs
aggregates by (host, node, segment) and joins back to paths; a node of one path
is done, so there are as many levels as paths share, however deep they are. Keys
that hold many rows, as one host may, are dealt out (``skew``).

Defined results: a null url or one without ``://`` has an empty host and path
and forms a template with its like; rules compare case-sensitively in the path;
repeated rows count each; a null label is no label; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .skew import spread_join

MANY_WORDS, MANY_OTHERS = 8, 2  # distinct values of a variable segment, at least: words, other kinds
SHARE = 0.3  # ... and per row
PRIOR, STRENGTH = 0.5, 4.0
PURITY = 0.9
CHI2 = 11.07  # 5 degrees of freedom, 5 %
_KINDS = ("end", "number", "number.ext", "hex", "mixed", "word")


@dataclass(frozen=True)
class Rule:
    """``target`` is a host, which covers its subdomains, and the path's beginning."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


RULES = [
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
]


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.char_length(rest) + 4, F.char_length(url))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, lower)
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.char_length(rest) + 4, F.char_length(url))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as its position in ``rules``; else null."""
    found = F.lit(None).cast("int")
    for rule in sorted(rules, key=lambda r: len(r.target)):
        i = rules.index(rule)
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def _kind(segment: Column) -> Column:
    return (
        F.when(segment.isNull(), "end")
        .when(segment.rlike(r"^[0-9]+$"), "number")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), "number.ext")
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-f-]{8,}$"), "hex")
        .when(segment.rlike(r"[0-9]"), "mixed")
        .otherwise("word")
    )


def path_templates(paths: DataFrame) -> DataFrame:
    """Distinct ``paths(host, path, n, labelled, blocked)``, counts of rows, with ``template``."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    node, counts = ["host", "template"], ["n", "labelled", "blocked"]
    state = stored(paths.withColumn("segments", segments).withColumn("template", F.lit("")))
    done, level = [state.where("size(segments) = 0")], 0
    state = state.where("size(segments) > 0")
    while not state.isEmpty():
        here = F.get("segments", F.lit(level))
        child = _kind(F.get("segments", F.lit(level + 1)))
        state = state.withColumn("segment", here).withColumn("kind", _kind(here))
        values = state.groupBy(*node, "kind", "segment").agg(
            *(F.sum(c).alias(c) for c in counts), F.count("*").alias("paths"),
            *(F.sum(F.when(child == k, F.col("n")).otherwise(0)).alias(f"k{i}") for i, k in enumerate(_KINDS)),
        )
        values = stored(values)
        # Variable segments of a node become one wildcard per kind.
        spread = values.groupBy(*node, "kind").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"))
        many = F.when(F.col("kind") == "word", MANY_WORDS).otherwise(MANY_OTHERS)
        variable = (F.col("n_values") >= many) & (F.col("n_values") >= SHARE * F.col("n_rows"))
        wild = spread.where(variable).select(*node, "kind", F.lit(True).alias("wild"))
        branches = spread_join(values, wild, [*node, "kind"], ["segment"]).where("wild is null").drop("wild")
        # A branch joins its siblings if its children, and its labels if there are any, look like all of theirs together.
        pool = branches.groupBy(*node).agg(
            F.count("*").alias("siblings"), *(F.sum(c).alias(f"all_{c}") for c in counts),
            *(F.sum(f"k{i}").alias(f"all{i}") for i in range(len(_KINDS))),
        )
        expected = [F.col(f"all{i}") * F.col("n") / F.col("all_n") for i in range(len(_KINDS))]
        chi2 = sum(
            (F.coalesce(F.try_divide((F.col(f"k{i}") - e) * (F.col(f"k{i}") - e), e), F.lit(0.0)) for i, e in enumerate(expected)),
            F.lit(0.0),
        )
        rate = F.try_divide("all_blocked", "all_labelled")
        slack = 1.96 * F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled")))
        agree = (F.col("labelled") == 0) | (F.abs(F.try_divide("blocked", "labelled") - rate) <= slack + 1e-9)
        like = F.coalesce((F.col("siblings") >= 2) & (chi2 <= CHI2) & agree, F.lit(False))
        told = spread_join(branches, pool.where("siblings > 1"), node, ["segment"]).select(
            *node, "segment", like.alias("like"), (~like & (F.col("paths") == 1)).alias("alone")
        )
        step = spread_join(state, wild, [*node, "kind"], ["path"])
        step = spread_join(step, told.where("like or alone"), [*node, "segment"], ["path"])
        name = F.when(F.col("wild"), F.concat(F.lit("{"), "kind", F.lit("}"))).when(F.col("like"), "{like}").otherwise(F.col("segment"))
        rest = F.when(F.col("alone"), F.slice("segments", level + 2, 1 << 20)).otherwise(F.array().cast("array<string>"))
        parts = F.concat(F.array("template", name), rest)
        last = F.coalesce("alone", F.lit(False)) | (F.size("segments") == level + 1)
        step = stored(
            step.select("host", "path", *counts, "segments", F.array_join(parts, "/").alias("template"), last.alias("last"))
        )
        done.append(step.where("last").drop("last"))
        state, level = step.where("not last").drop("last"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("segments")


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``, one row per row of ``pages``."""
    rules = RULES if rules is None else rules
    url = pages[url_col]
    parsed = pages.select(pages[id_col].alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    blocks = F.array(*(F.lit(1 if r.verdict == "block" else 0) for r in rules)) if rules else F.array(F.lit(0))
    names = F.array(*(F.lit(r.target) for r in rules)) if rules else F.array(F.lit(""))
    paths = parsed.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("label", F.get(blocks, found))
    paths = paths.select(
        "host", "path", "n", F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0).alias("labelled"),
        (F.coalesce("label", F.lit(0)) * F.col("n")).alias("blocked"),
    )
    templates = path_templates(paths)
    purity = templates.groupBy("host", "template").agg(
        ((F.sum("blocked") + PRIOR * STRENGTH) / (F.sum("labelled") + STRENGTH)).alias("purity")
    )
    known = spread_join(templates.select("host", "path", "template"), purity, ["host", "template"], ["path"])
    judged = spread_join(parsed, known, ["host", "path"], ["row"], "inner").withColumn("found", found)
    verdict = F.when(F.coalesce(F.get(blocks, F.col("found")), (F.col("purity") >= PURITY).cast("int")) == 1, "block")
    return judged.select(
        F.col("row").alias("page_id"), "host", "path", F.get(names, F.col("found")).alias("rule"),
        verdict.otherwise("allow").alias("verdict"), "template", "purity",
    )
