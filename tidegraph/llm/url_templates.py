"""URL filters: fixed rules by host and path, and a tree of path templates for the URLs that no rule fits.

All of it is column expressions, joins and groupings; rows of a host or template that holds a good part of all are dealt by a salt. The URLs that a rule fits are the labelled samples. Per host, paths are
turned into templates segment by segment: below each template, a segment that holds a fair share of the URLs stays as it is and
all others become a wildcard; then branches whose URLs are blocked, allowed and unlabelled in about the same shares are merged,
so that they share all that follows. A template is rejected if its smoothed share of blocked samples is high.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegraph.llm.common import drop_folder, hot_keys, looked_up, staged_at

#: Segments of a path that are told apart; what follows is one wildcard.
DEPTH = 4
#: URLs that a segment needs below its template to stay as it is, and the share of them it needs, in one of so many.
SUPPORT, SHARE = 3, 20
#: Two branches merge if chi-square of (blocked, allowed, unlabelled) is below this (2 degrees of freedom, 0.05).
ALIKE = 5.99
#: Samples, half of them blocked, that are added to those of a template, and the share of blocked ones from which it is rejected:
#: five samples, all of them blocked, are the fewest that reject a template.
WEIGHT, REJECT = 5.0, 0.75


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end.

    Null, or without ``://``: both empty.
    """
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _fitting(rules: list[Rule]) -> Column:
    """(rule, verdict) of the first rule in the order of preference that fits ``host`` and ``path``; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(set(rules), key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block", r.path, r.host))
    made = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in order])
    below = lambda r: (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
    first = F.get(F.filter(made, lambda r: below(r) & F.startswith(F.col("path"), r["path"])), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def _level(rows: DataFrame, count: int) -> tuple[DataFrame, str]:
    """The ``count`` ``rows`` (at, rest and others), staged, and their folder, with the next segment of ``rest`` moved to the template ``at``."""
    spark = rows.sparkSession
    first = F.get("rest", F.lit(0))
    wild = F.when(F.col("segment").rlike("^[0-9]+$"), "{n}").otherwise("*")
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    children = rows.where(F.size("rest") > 0).groupBy("host", "at", first.alias("segment")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked"), F.count(F.when(F.col("label") == "allow", 1)).alias("allowed"))
    children, path = staged_at(spark, children, "children")
    total = children.groupBy("host", "at").agg(F.sum("n").alias("total"))
    hot = hot_keys(total, ["host", "at"], "total", count)
    # segments that stay are few for each template, so what is joined to the totals is small
    common = children.where(F.col("n") >= SUPPORT).join(total, ["host", "at"]).where(F.col("n") * SHARE >= F.col("total"))
    stays = common.select("host", "at", "segment", F.lit(True).alias("stays"))
    marked = children.join(stays, ["host", "at", "segment"], "left")
    # a wildcard and a segment of the same spelling are told apart by the quote
    branch = F.when(F.col("stays"), F.concat(F.lit("'"), F.col("segment"))).otherwise(wild)
    branches = marked.groupBy("host", "at", branch.alias("branch")).agg(*sums())
    unlabelled = F.col("n") - F.col("blocked") - F.col("allowed")
    side = Window.partitionBy("host", "at").orderBy(F.col("blocked") / F.col("n"), F.col("allowed") / F.col("n"), "branch")  # SHARE + 2 at most
    mine = [F.col("blocked"), F.col("allowed"), unlabelled]
    theirs = [F.lag(c).over(side) for c in mine]
    n, m = F.col("n"), F.lag("n").over(side)

    def part(x: Column, y: Column) -> Column:
        """Of chi-square over two rows: (x m - y n)^2 / (n m (x + y))."""
        return F.when(x + y > 0, (x * m - y * n).cast("double") * (x * m - y * n) / (n.cast("double") * m * (x + y))).otherwise(0.0)
    differ = sum((part(x, y) for x, y in zip(mine[1:], theirs[1:])), part(mine[0], theirs[0])) >= ALIKE
    grouped = branches.withColumn("new", F.coalesce(differ, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(side))
    whole = Window.partitionBy("host", "at", "group")
    named = grouped.withColumn("name", F.array_join(F.array_sort(F.collect_list("branch").over(whole)), "|"))
    names = named.groupBy("host", "at").agg(F.map_from_entries(F.collect_list(F.struct("branch", "name"))).alias("names"))
    quoted = F.concat(F.lit("'"), F.col("segment"))
    name = F.coalesce(F.get(F.filter(F.map_entries("names"), lambda e: e["key"] == quoted), F.lit(0))["value"], F.get(F.filter(F.map_entries("names"), lambda e: e["key"] == wild), F.lit(0))["value"])
    names, names_path = staged_at(spark, names, "branches")
    joined = looked_up(rows.withColumn("segment", first), names, ["host", "at"], hot, "left")
    moved = joined.withColumns({"at": F.when(F.size("rest") > 0, F.concat("at", F.lit("/"), name)).otherwise(F.col("at")), "rest": F.when(F.size("rest") > 0, F.expr("slice(rest, 2, size(rest))")).otherwise(F.col("rest"))})
    out = staged_at(spark, moved.select(*rows.columns), "templates")
    drop_folder(spark, path)
    drop_folder(spark, names_path)
    return out


def judged(pages: DataFrame, rules: list[Rule], keep: list[str], url_column: str = "url") -> DataFrame:
    """The kept columns of every row, with host, path, rule, template, purity and verdict.

    ``rule``: host and path of the longest rule that fits (equal lengths: of the longer host, then a blocking one), else null;
    a rule fits its host and all subdomains if the path starts with the rule's. ``template`` and its ``purity``, the smoothed
    share of blocked URLs among those with a rule, are the method's. ``verdict``: the rule's; without one ``block`` if the purity
    is at least ``REJECT``, else ``allow``. ``rules`` is a configuration list: each row compares it in order.

    A null URL, or one without ``://``, has an empty host and path and shares the template of all such URLs. An empty segment is
    a segment like others. Repeated rows are kept and counted. No rule, or none that fits: all are allowed. An empty table gives
    no rows. Kept columns must not have the names of the new ones; others are not looked at.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(*[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)], host.alias("host"), path.alias("path")).withColumn("fit", _fitting(rules))
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    some = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.slice(segments, 1, DEPTH))
    deeper = F.when(F.size(segments) > DEPTH, "/**").otherwise("")
    rows = rows.select(
        *[c for c in rows.columns if c != "fit"], F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("label"),
        F.lit("").alias("at"), some.alias("rest"), deeper.alias("deeper"),
    )
    rows, at = staged_at(spark, rows, "labelled")
    count, levels = rows.agg(F.count("*"), F.max(F.size("rest"))).first()
    for _ in range(levels or 0):
        before = at
        rows, at = _level(rows, count)
        drop_folder(spark, before)
    rows = rows.withColumn("template", F.concat("host", "at", "deeper"))
    blocked, labelled = F.count(F.when(F.col("label") == "block", 1)), F.count("label")
    leaves, _ = staged_at(spark, rows.groupBy("template").agg(((blocked + WEIGHT / 2) / (labelled + WEIGHT)).alias("purity"), F.count("*").alias("n")), "leaves")
    hot = hot_keys(leaves, ["template"], "n", count)
    verdict = F.coalesce("label", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return looked_up(rows, leaves.drop("n"), ["template"], hot).select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)], "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
