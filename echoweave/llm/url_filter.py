"""URL filter: a tree of path templates for each host.

Numbers in a path are wildcards from the start (``#``). Going down the tree
level by level, a node with many rare children turns these into one wildcard
(``*``). Then similar branches are merged, so that their subtrees become one:
siblings whose share of good labelled pages doesn't differ significantly from
their parent's are one branch (``*``), and so are those that lie above it (``*>``)
or below (``*<``), but for branches that differ from the others on their side.
Each node's share is smoothed towards its parent's. Templates of a low smoothed
share are rejected. Fixed rules on host and path prefix come first.

The tree ends where nothing more can be told: at the end of the paths, or where
a node has no label or one path shape only (``**`` stands for the rest).

Scale: pages are reduced to counts of (host, path shape) in the scan with
map-side combine; the tree works on those counts, one checkpoint a level. The
verdict is joined back to the pages by (host, shape), a join that Spark's
adaptive execution splits for a host with very many pages. html is never read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns, tidy_shuffles

#: (rule, verdict): host, then the path's start.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A child with less than a 1/RARE of the node's pages is rare; a node with so many children makes a wildcard of the rare ones.
MANY_CHILDREN, RARE = 16, 64
#: Pages that a parent's share counts for; significance of a difference; the lowest share that is allowed.
SMOOTHING, Z, PURITY = 8.0, 1.96, 0.5


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and its path's start."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """Segments joined by /, runs of digits as #."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda s: s != ""), "/")


def differs(lab: Column, good: Column, other_lab: Column, other_good: Column) -> Column:
    """1 or -1 where the first share is significantly above or below the second; 0 if not, or without labels."""
    pooled = F.try_divide(good + other_good, lab + other_lab)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), lab) + F.try_divide(F.lit(1.0), other_lab)))
    gap = F.try_divide(good, lab) - F.try_divide(other_good, other_lab)
    return F.when(gap > Z * spread, 1).when(-gap > Z * spread, -1).otherwise(0)


def smoothed(lab: Column, good: Column, parent_lab: Column, parent_good: Column, parent_value: Column) -> Column:
    """A node's share of good pages; the parent's if the two don't differ significantly."""
    own = (good + SMOOTHING * parent_value) / (lab + SMOOTHING)
    return F.when(differs(lab, good, parent_lab, parent_good) != 0, own).otherwise(parent_value)


def branches(rows: DataFrame) -> DataFrame:
    """rows(host, template, seg, n, lab, good, p_lab, p_good) -> host, template, seg, to: the branch that each child of a node becomes."""
    node, total = ["host", "template"], [F.sum(c).cast("double").alias(c) for c in ("n", "lab", "good")]
    parent = [F.max(c).alias(c) for c in ("p_lab", "p_good")]
    child = rows.groupBy(*node, "seg").agg(*total, *parent)
    size = child.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("node_n"))
    variable = (F.col("children") >= MANY_CHILDREN) & (F.col("n") * RARE < F.col("node_n"))
    child = child.join(size, node).withColumn("name", F.when(variable, "*").otherwise(F.col("seg")))
    branch = child.groupBy(*node, "name").agg(*total, *parent).withColumn("side", differs(F.col("lab"), F.col("good"), F.col("p_lab"), F.col("p_good")))
    side = branch.groupBy(*node, "side").agg(F.sum("lab").alias("s_lab"), F.sum("good").alias("s_good"), F.count(F.lit(1)).alias("many"))
    like = (F.col("many") > 1) & (differs(F.col("lab"), F.col("good"), F.col("s_lab"), F.col("s_good")) == 0)
    merged = F.when(F.col("side") > 0, "*>").when(F.col("side") < 0, "*<").otherwise("*")
    named = branch.join(side, [*node, "side"]).select(*node, "name", F.when(like, merged).otherwise(F.col("name")).alias("to"))
    return child.select(*node, "seg", "name").join(named, [*node, "name"]).select(*node, "seg", "to")


def templates(shapes: DataFrame) -> DataFrame:
    """shapes(host, shape, n, lab, good) -> host, shape, template, value: the smoothed share of good pages of its template."""
    total = shapes.agg(F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    prior = (total.good + 1.0) / (total.lab + 1.0)
    rows = shapes.withColumns({"template": F.lit(""), "p_lab": F.lit(total.lab).cast("double"), "p_good": F.lit(total.good).cast("double"), "value": F.lit(prior), "left": F.split("shape", "/")})

    def settle(rows: DataFrame) -> DataFrame:
        """Bring each row's value and counts from its parent node to the node named by its template, and count the node's shapes."""
        node = rows.groupBy("host", "template").agg(F.sum("lab").cast("double").alias("n_lab"), F.sum("good").cast("double").alias("n_good"), F.count(F.lit(1)).alias("shapes"))
        rows = rows.drop("shapes").join(node, ["host", "template"])
        value = smoothed(F.col("n_lab"), F.col("n_good"), F.col("p_lab"), F.col("p_good"), F.col("value"))
        return checkpointed(rows.select("host", "shape", "template", "n", "lab", "good", F.col("n_lab").alias("p_lab"), F.col("n_good").alias("p_good"), value.alias("value"), "left", "shapes"))

    done, rows = [], settle(rows)
    while True:
        ended = F.coalesce(F.get("left", F.lit(0)), F.lit("")) == ""
        told = ended | (F.col("p_lab") == 0) | (F.col("shapes") == 1)
        done.append(rows.where(told).select("host", "shape", F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/**"))).alias("template"), "value"))
        rows = rows.where(~told).withColumn("seg", F.get("left", F.lit(0)))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows = rows.join(branches(rows), ["host", "template", "seg"])
        rows = settle(rows.withColumns({"template": F.concat("template", F.lit("/"), "to"), "left": F.slice("left", F.lit(2), F.greatest(F.size("left") - 1, F.lit(0)))}))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, purity: float = PURITY) -> DataFrame:
    """pages(page_id, url), labels(doc_id, quality) -> page_id, host, path, rule, verdict, template.

    A page's label is that of the document with its id; of several labels the
    smallest counts, null ones don't. Null urls and urls without ``://`` have an
    empty host and path and are one template. Repeated rows are judged each for
    itself, whatever their ids; a null id has no label. No labels: what no rule
    blocks is allowed. No pages: no rows. Other columns are ignored.
    """
    good = doc_columns(labels, "doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = doc_columns(pages, "page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("path")))
    counts = rows.join(good, rows["page_id"] == good["doc_id"], "left").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("_good").alias("lab"), F.coalesce(F.sum(F.when(F.col("_good") == 1, 1)), F.lit(0)).alias("good"))
    with tidy_shuffles(pages.sparkSession):
        tree = templates(checkpointed(counts))
    out = rows.join(tree, ["host", "shape"]).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    by_tree = F.when(F.col("value") < purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_tree).alias("verdict"), "template")
