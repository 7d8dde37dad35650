"""URL filtering by a tree of path templates, in DataFrame operations only.

Per host, path segments that are rare below their parent become wildcards, sibling branches whose labelled shares
do not differ significantly are merged, and a template is rejected if its smoothed share of blocked urls is high.
Labels come from explicit rules, which also win over the templates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequality.session import cut_lineage

DEPTH = 4  # tree levels; what lies deeper is one last segment
LEAST_URLS = 20  # of a segment that stays literal
LEAST_SHARE = 0.05  # of its parent's urls, likewise; so a parent has at most 20 literal children
SIGNIFICANT = 1.96  # standard errors by which branches must differ to stay apart
PRIOR_WEIGHT = 5.0
REJECT_AT = 0.8
WILDCARD = "*"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(_behind(url), r"^[^/?#]*", 0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def _behind(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + F.lit(3))


def path_of(url: Column) -> Column:
    """What stands between the host and the next ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(size, host_size, rule, verdict), or null.

    The list is configuration and travels inside the plan; a rule fits its host and all subdomains of it.
    """
    fitting = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.text)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.text).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None)


def _segments(path: Column, depth: int) -> Column:
    """Segments of a path behind its first slash; from ``depth`` on they are one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    tail = F.array_join(F.slice(parts, depth, F.greatest(F.size(parts) - (depth - 1), F.lit(0))), "/")
    return F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth - 1), F.array(tail)))


def merge_branches(children: DataFrame) -> DataFrame:
    """(host, parent, segment, branch) of the literal ``children``: siblings in order of their blocked share form one
    branch as long as neighbours don't differ significantly; those without labels form one of their own."""
    known = F.col("labelled") > 0
    n, m = (F.nullif(F.col(c), F.lit(0)) for c in ("labelled", "n"))  # null without labels: then nothing differs
    share = F.col("blocked") / n
    row = Window.partitionBy("host", "parent", "known").orderBy("share", "segment")  # at most 1 / LEAST_SHARE rows
    pooled = (F.col("blocked") + F.col("b")) / (n + m)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    apart = F.coalesce(F.col("share") - F.col("b") / m > SIGNIFICANT * error, F.lit(False))
    grouped = (
        children.withColumn("known", known).withColumn("share", share)
        .withColumn("b", F.lag("blocked").over(row)).withColumn("n", F.lag("labelled").over(row))
        .withColumn("apart", apart.cast("int"))
        .withColumn("part", F.sum("apart").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    )
    names = F.sort_array(F.collect_list("segment").over(Window.partitionBy("host", "parent", "known", "part")))
    branch = F.when(F.size(names) > 1, F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("segment"))
    return grouped.select("host", "parent", "segment", branch.alias("branch"))


def url_templates(urls: DataFrame, depth: int = DEPTH, least_urls: int = LEAST_URLS,
                  least_share: float = LEAST_SHARE) -> DataFrame:
    """``urls`` (host, path, label: 'allow', 'block' or null, any more) with the column template.

    Level by level, only the literal children of each parent are written: few rows, made by partial counts and
    cut to frequent segments before any join. Urls are never gathered by host.
    """
    tree = urls.withColumn("_segments", _segments(F.col("path"), depth)).withColumn("template", F.lit(""))
    for level in range(depth):
        at = tree.where(F.size("_segments") > level).select(
            "host", F.col("template").alias("parent"), F.get("_segments", F.lit(level)).alias("segment"),
            F.col("label").isNotNull().cast("long").alias("labelled"),
            F.coalesce(F.col("label") == "block", F.lit(False)).cast("long").alias("blocked"),
        )
        counts = at.groupBy("host", "parent", "segment").agg(
            F.count("*").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
        ).where(F.col("urls") >= least_urls)
        totals = at.groupBy("host", "parent").agg(F.count("*").alias("all_urls"))
        literal = counts.join(totals, ["host", "parent"]).where(F.col("urls") >= least_share * F.col("all_urls"))
        branches = cut_lineage(merge_branches(literal)).withColumnsRenamed(
            {"host": "_host", "parent": "_parent", "segment": "_segment", "branch": "_branch"}
        )
        here = F.get("_segments", F.lit(level))
        step = F.concat("template", F.lit("/"), F.coalesce("_branch", F.lit(WILDCARD)))
        tree = tree.join(
            branches,
            (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_parent")) & (here == F.col("_segment")),
            "left",
        ).withColumn("template", F.when(here.isNotNull(), step).otherwise(F.col("template")))
        tree = tree.drop("_host", "_parent", "_segment", "_branch")
    return tree.drop("_segments")


def template_purity(tree: DataFrame, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """(host, template, purity): the share of blocked among a template's labelled urls, drawn towards the share
    in the whole table by ``prior_weight`` urls; null for a template without labelled urls."""
    blocked = F.coalesce(F.col("label") == "block", F.lit(False)).cast("long")
    counts = tree.groupBy("host", "template").agg(F.count("label").alias("labelled"), F.sum(blocked).alias("blocked"))
    overall = tree.agg(F.count("label").alias("_n"), F.sum(blocked).alias("_b"))
    prior = F.coalesce(F.col("_b") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0))
    purity = (F.col("blocked") + prior_weight * prior) / (F.col("labelled") + prior_weight)
    one_row = F.lit(1)
    return counts.withColumn("_k", one_row).join(overall.withColumn("_k", one_row), "_k").select(
        "host", "template", F.when(F.col("labelled") > 0, purity).alias("purity")
    )


def filter_urls(pages: DataFrame, rules: list[Rule], reject_at: float = REJECT_AT, depth: int = DEPTH) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of ``pages`` (page_id, url).

    A fitting rule decides; otherwise a template whose purity reaches ``reject_at`` blocks, and any other, such as one
    without labelled urls, allows.
    A null url, or one without ``://``, has an empty host and path. Repeated rows stay; null page_ids stay.
    Extra columns are ignored. An empty table gives no row.
    """
    found = F.col("_rule")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", found["rule"].alias("rule"), found["verdict"].alias("label")
    ) if rules else urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("label"))
    tree = url_templates(urls, depth)
    purity = cut_lineage(template_purity(tree)).withColumnsRenamed({"host": "_host", "template": "_template"})
    judged = tree.join(purity, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")), "left")
    learned = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("label", learned).alias("verdict"), "template", "purity"
    )
