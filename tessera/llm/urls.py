"""URL filters: host and path rules, then a path-template tree judged by labelled purity. DataFrame expressions only.

Rules: (verdict, host, path) fit a host and its subdomains if the URL's path starts with theirs; the longest wins.
Template tree, for what no rule decides: path segments are typed (digit runs, long hexadecimal runs), equal typed paths
of a host are aggregated to shapes with their numbers of pages, labels and bad labels, and the tree of each host is
built over shapes level by level. At a node, a child whose rate of bad labels does not differ from the node's by more
than Z standard errors becomes the wildcard, so that statistically similar branches merge; so does a child with fewer
than MIN_LABELS labels that has less than SUPPORT of the node's pages. A child that differs by MIN_LABELS labels or more
stays, however large its node is. Paths that take the same steps share a template. A template's purity is its share of
bad labels, smoothed towards its host's, which is smoothed towards the rate of all; templates from REJECT on are blocked.

Everything after the first aggregation works on shapes; pages are joined with the verdicts of their shapes.

Defined cases: a null URL or one without ``://`` has empty host and path and is judged as a shape of its own;
segments beyond DEPTH are one wildcard; unlabelled pages count for support only; several labels of a page count as bad
if one is; repeated rows count each; an empty table gives an empty result; result columns replace input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

DEPTH = 6
SUPPORT = 0.05
#: Labels from which a branch needs no support.
MIN_LABELS = 5
Z = 2.0
#: Weight of the next wider rate in smoothing.
SMOOTHING = 5.0
REJECT = 0.8
ANY = "*"

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def typed_path(path: Column) -> Column:
    """The path with digit and long hexadecimal runs typed, without empty segments."""
    low = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f]{8,}(-[0-9a-f]{4,})*(?![0-9a-z])", "{hex}"), r"[0-9]+", "{num}")
    return F.array_join(F.filter(F.split(low, "/"), lambda s: F.length(s) > 0), "/")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, pages, labelled, bad) -> (host, shape, template), level by level over the hosts' trees."""
    segments = F.split("shape", "/")
    state = shapes.select("host", "shape", "pages", "labelled", "bad", F.lit("").alias("template"))
    for depth in range(DEPTH + 1):
        child = F.when((F.col("shape") == "") | (F.size(segments) <= depth), F.lit(None)).otherwise(F.lit(ANY) if depth == DEPTH else F.get(segments, F.lit(depth)))
        state = state.withColumn("child", child)
        if depth == DEPTH:
            return state.select("host", "shape", F.when(F.col("child").isNotNull(), F.concat("template", F.lit(f"/{ANY}"))).otherwise(F.col("template")).alias("template"))
        sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]
        branches = state.where(F.col("child").isNotNull()).groupBy("host", "template", "child").agg(*sums)
        nodes = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "bad")])
        rate = F.try_divide(F.col("all_bad"), F.col("all_labelled"))
        apart = F.abs(F.col("bad") - F.col("labelled") * rate) > Z * F.sqrt(F.col("labelled") * rate * (1 - rate))
        backed = (F.col("labelled") >= MIN_LABELS) | (F.col("pages") >= SUPPORT * F.col("all_pages"))
        own = branches.join(nodes, ["host", "template"]).where(backed & F.coalesce(apart, F.lit(False)))
        own = own.select(F.col("host").alias("own_host"), F.col("template").alias("own_template"), F.col("child").alias("own_child"))
        found = state.join(own, (F.col("host") == F.col("own_host")) & (F.col("template") == F.col("own_template")) & (F.col("child") == F.col("own_child")), "left")
        step = F.when(F.col("child").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("own_child", F.lit(ANY))))
        # A written table per level keeps the plan small; it has a row per shape.
        state = materialise(found.select("host", "shape", "pages", "labelled", "bad", step.alias("template")), "url-tree")
    raise AssertionError("not reached")


def purity(shapes: DataFrame) -> DataFrame:
    """(host, shape, ...) -> host, shape, template and its smoothed share of bad labels."""
    placed = shapes.join(templates(shapes), ["host", "shape"])
    whole = shapes.agg((F.sum("bad") + 1.0).alias("b"), (F.sum("labelled") + 2.0).alias("n")).first()
    base = (whole.b or 1.0) / (whole.n or 2.0)
    hosts = shapes.groupBy("host").agg(((F.sum("bad") + SMOOTHING * base) / (F.sum("labelled") + SMOOTHING)).alias("host_rate"))
    rated = placed.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n")).join(hosts, "host")
    rated = rated.select("host", "template", ((F.col("b") + SMOOTHING * F.col("host_rate")) / (F.col("n") + SMOOTHING)).alias("purity"))
    return placed.select("host", "shape", "template").join(rated, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, reject: float = REJECT) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule, template, purity and verdict.

    ``labels`` (page_id, bad): further labels beside the verdicts of the rules.
    """
    made = ("host", "path", "rule", "template", "purity", "verdict")
    held = [c for c in pages.columns if c.lower() not in made]
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    # Input columns travel in a struct, so that none can clash with a name used here.
    row = F.struct(*[F.col(f"`{c}`") for c in held]).alias("row")
    parsed = pages.select(row, F.col("page_id").alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"), typed_path(F.col("path")).alias("shape"))
    seen = parsed.select("page", "host", "shape", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0).alias("bad"))
    if labels is not None:
        told = labels.groupBy(F.col("page_id").alias("told")).agg(F.max(F.col("bad").cast("int")).alias("told_bad"))
        seen = seen.join(told, F.col("page") == F.col("told"), "left").withColumn("bad", F.coalesce("bad", "told_bad"))
    shapes = seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    judged = materialise(purity(materialise(shapes, "url-shapes")), "url-purity").withColumnsRenamed({"host": "shape_host", "shape": "own_shape"})
    out = parsed.join(judged, (F.col("host") == F.col("shape_host")) & (F.col("shape") == F.col("own_shape")), "left")
    by_tree = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in held], "host", "path", "rule", "template", "purity", F.coalesce("by_rule", by_tree).alias("verdict"))
