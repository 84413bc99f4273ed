"""URL filter: a path-template tree per host, judged by the smoothed purity of labelled pages.

Every step is a DataFrame operation on (host, path shape) counts, which are combined before their
shuffle; only the first and the last step see the pages themselves.

1. A path becomes its shaped segments: digits, long hex strings and percent escapes are
   replaced by wildcards, as are file stems that hold digits.
2. Level by level, from the host down to the deepest segment of any path, the children of a template are compared with their siblings:
   a child whose label rate (two-proportion z) and whose next segments (total variation) are both
   like those of the siblings together is merged into ``*``.  A branch that differs stays.  Pages that end
   where others go on are a branch of their own.
3. From the leaf up, a template's purity is the share of blocked pages among its labelled pages,
   smoothed towards its parent's purity with the weight of ``ALPHA`` pages; the host's is smoothed
   towards that of all hosts, that one towards ``PRIOR``.  Shorter paths count as ``DEPTH`` levels, of which
   the missing ones repeat the last; longer ones have as many as they have segments.  A template at or above ``REJECT`` is
   rejected.

The walk takes some jobs a level, over the counts of paths that reach it; a path of hundreds of segments
makes as many levels.

Rules come before the method: the longest rule whose host and path fit decides.

Defined cases: a null url, or one without ``://``, has an empty host and path and belongs to the
template of the empty host; no labelled page at all gives every template the prior, which allows;
repeated rows get the same verdict each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.names import unused
from ranklake.sources.storage import discard, stored

#: Levels that every path has at least.
DEPTH = 4
ALPHA = 5.0
PRIOR = 0.25
REJECT = 0.6
Z_LIKE = 2.576
SHAPE_LIKE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``rule`` is a host, then a path that begins with ``/``."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


#: The rules of the registered query.
RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, or null."""
    fitting = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        on_host = (host == r.host) | host.endswith("." + r.host)
        fitting = F.when(on_host & path.startswith(r.path), F.lit(r.rule)).otherwise(fitting)
    return fitting


def segment_shape(segment: Column) -> Column:
    """A segment with its variable parts as wildcards."""
    hexed = F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "<x>")
    return F.regexp_replace(F.regexp_replace(hexed, r"%[0-9A-Fa-f]{2}", "<e>"), r"[0-9]+", "<n>")


def shapes(path: Column) -> Column:
    """Array of all shaped segments."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")
    return F.transform(F.filter(parts, lambda x: x != ""), segment_shape)


def _segment(level: int) -> Column:
    """The segment at a level; empty where the path has ended."""
    return F.coalesce(F.get(F.col("shape"), F.lit(level)), F.lit(""))


def _merge_level(nodes: DataFrame, level: int) -> DataFrame:
    """Adds to ``tpl`` the segment at ``level``, as ``*`` where that branch is like its siblings.

    ``only`` says whether the branch has no sibling.
    """
    parent = ["host", "tpl"]
    nodes = nodes.withColumn("me", _segment(level)).withColumn("following", _segment(level + 1))
    totals = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    child = nodes.groupBy(*parent, "me").agg(*totals)
    whole = nodes.groupBy(*parent).agg(
        F.sum("n").alias("pn"), F.sum("good").alias("pgood"), F.sum("bad").alias("pbad"),
        F.min("me").alias("least"), F.max("me").alias("most"),
    )
    child = child.join(whole, parent)
    # Rates of the branch and of its siblings, each with one page of either label added.
    k, rest = F.col("good") + F.col("bad"), F.col("pgood") + F.col("pbad") - F.col("good") - F.col("bad")
    rate, others = (F.col("bad") + 1) / (k + 2), (F.col("pbad") - F.col("bad") + 1) / (rest + 2)
    pooled = (F.col("pbad") + 2) / (k + rest + 4)
    z = F.abs(rate - others) / F.sqrt(pooled * (1 - pooled) * (1 / (k + 2) + 1 / (rest + 2)))
    only = F.col("least") == F.col("most")
    child = child.withColumn("only", only).withColumn("like", ~only & (z < Z_LIKE) & (F.col("me") != ""))
    # Total variation between the branch's next segments and those below all siblings.
    below = nodes.groupBy(*parent, "me", "following").agg(F.sum("n").alias("c"))
    under = nodes.groupBy(*parent, "following").agg(F.sum("n").alias("pc"))
    common = (
        below.join(under, [*parent, "following"])
        .join(child.select(*parent, "me", "n", "pn"), [*parent, "me"])
        .groupBy(*parent, "me")
        .agg(F.sum(F.least(F.col("c") / F.col("n"), F.col("pc") / F.col("pn"))).alias("overlap"))
    )
    like = F.col("like") & (F.col("overlap") >= 1 - SHAPE_LIKE)
    child = child.join(common, [*parent, "me"]).select(*parent, "me", "only", like.alias("like"))
    merged = F.concat("tpl", F.array(F.when(F.col("like"), F.lit("*")).otherwise(F.col("me"))))
    return nodes.join(child, [*parent, "me"]).withColumn("tpl", merged).drop("me", "following", "like")


def _smoothed(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``nodes`` with ``p`` smoothed by the labelled pages of their ``key``, and their number."""
    here = nodes.groupBy(*key).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    labelled = F.col("g") + F.col("b")
    purity = (F.col("b") + ALPHA * F.col("p")) / (labelled + ALPHA)
    return nodes.join(here, [*key]).withColumn("new", purity).withColumn("labelled", labelled).drop("g", "b")


def template_tree(shaped: DataFrame) -> DataFrame:
    """Templates of all shapes: host, shape (as read), template, purity, labelled.

    ``shaped`` has host, shape (array) and bad (1, 0 or null where a page has no label).
    """
    counts = shaped.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("bad") == 0, 1)).alias("good"),
        F.count(F.when(F.col("bad") == 1, 1)).alias("bad"),
    )
    nodes = stored(counts.withColumn("tpl", F.array().cast("array<string>")), "url_shapes")
    root = nodes.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max(F.size("shape")).alias("deepest")).first()
    good, bad, deepest = (root[c] or 0 for c in ("good", "bad", "deepest"))
    prior = nodes.withColumn("p", F.lit((bad + PRIOR * ALPHA) / (good + bad + ALPHA)))
    active = stored(_smoothed(prior, ["host"]).withColumn("p", F.col("new")).drop("new", "labelled"), "url_nodes")
    discard(nodes)
    read = [active]
    # A path of DEPTH segments or more has one level for its end.
    levels = F.when(F.size("shape") < DEPTH, DEPTH).otherwise(F.size("shape") + 1)
    finished = []
    for level in range(DEPTH if deepest < DEPTH else deepest + 1):
        # Each level reads its input several times.
        merged = stored(_merge_level(active, level), "url_merged")
        new = F.col("new")
        if level >= DEPTH:
            # An end that is the only branch is its parent.
            new = F.when(F.col("only") & (_segment(level) == ""), F.col("p")).otherwise(new)
        scored = stored(_smoothed(merged, ["host", "tpl"]).withColumn("p", new).drop("new", "only"), "url_nodes")
        discard(merged, *read)
        read = []
        if level < DEPTH - 1:
            active, read = scored.drop("labelled"), [scored]
        else:
            finished.append(scored.filter(levels == level + 1))
            active = scored.filter(levels > level + 1).drop("labelled")
    nodes = reduce(DataFrame.unionByName, finished)
    template = F.concat_ws("/", F.filter("tpl", lambda x: x != ""))
    return nodes.select("host", "shape", F.concat(F.lit("/"), template).alias("template"), F.col("p").alias("purity"), "labelled")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", label: str | None = None) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict.

    The labelled pages are those that a rule fits (blocked: bad), and where ``label`` names a column
    (1 bad, 0 good, null unknown), those it labels.
    """
    added = ("host", "path", "rule", "template", "purity", "verdict")
    own = [c for c in pages.columns if c not in added]
    parsed = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for r in rules:
        ruled = F.when(F.col("rule") == r.rule, F.lit(r.verdict)).otherwise(ruled)
    bad = F.when(ruled == "block", 1).when(ruled == "allow", 0)
    if label:
        bad = F.coalesce(bad, F.col(label).cast("int"))
    shape, tree_host, tree_shape = (unused(c, parsed.columns) for c in ("_shape", "_host", "_tshape"))
    shaped = parsed.withColumn(shape, shapes(F.col("path")))
    tree = template_tree(shaped.select("host", F.col(shape).alias("shape"), bad.alias("bad")))
    tree = tree.select(F.col("host").alias(tree_host), F.col("shape").alias(tree_shape), "template", "purity")
    return shaped.join(tree, (F.col("host") == F.col(tree_host)) & (F.col(shape) == F.col(tree_shape)), "left").select(
        *own, "host", "path", "rule", "template", "purity",
        F.coalesce(ruled, F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
    )
