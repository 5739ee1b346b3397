"""URL filters: fixed rules, and for all other pages a path-template tree learned per host.

The tree is grown one path segment a level, for all hosts at once, to the last segment of any page. A
segment with enough pages of its own, whatever the size of its host, keeps a branch; all others, ids
and dates and slugs, share the branch `*`. A branch is held against the other branches of its node
by two tests of proportions: how many of its labelled pages are blocked, and how many of its pages end
here. Branches that differ from the others in the same way, or in none, are statistically alike and
are merged; a branch without labels differs by its shape alone, and so gets the labels of those it is
merged with. A template is a path from the root to a leaf. Its purity is the blocked share of its labelled
pages, smoothed towards the share in all labelled pages; templates at or above the threshold are
rejected if they have labelled pages and stay there when smoothed towards a half. The pages that the
rules decide are the labels.

DataFrame expressions alone. Statistics are summed before they are shuffled, and what is joined
back to the pages are branches with MIN_PAGES pages or more, so one host may hold any share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host with its subdomains, for paths that start with the rule's."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class Tree:
    """Parameters of the method."""

    min_pages: int = 8  # pages below which a segment never has a branch of its own
    differs: float = 6.63  # chi-square from which two shares differ (one chance in a hundred)
    weight: float = 5.0  # of the prior, in pages
    threshold: float = 0.8


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty without `://`."""
    u = F.coalesce(url, F.lit(""))
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, found, 1), UPPER, LOWER), F.regexp_extract(u, found, 2)


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(text, verdict); null if none does."""
    none = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        none = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(none)
    return none


def _against(hits: str, misses: str, differs: float) -> Column:
    """Whether a branch's share of hits is above (+) or below (-) that of the other branches of its node
    (columns all_*), or no other (=), by the chi-square of the two-by-two table."""
    a, b = F.col(hits).cast("double"), F.col(misses).cast("double")
    c, d = F.col(f"all_{hits}") - a, F.col(f"all_{misses}") - b
    cross, margins = a * d - b * c, (a + b) * (c + d) * (a + c) * (b + d)
    return F.when((margins > 0) & (cross * cross * (a + b + c + d) >= differs * margins), F.when(cross > 0, "+").otherwise("-")).otherwise("=")


def _grown(rows: DataFrame, level: int, t: Tree) -> DataFrame:
    """Rows with the node one level down."""
    at = F.get("segments", F.lit(level))
    rows = rows.withColumn("segment", at)
    ends = F.sum(F.when(F.size("segments") == level + 1, 1).otherwise(0))
    child = rows.where("segment is not null").groupBy("host", "node", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), ends.alias("ends"))
    child = child.where(F.col("n") >= t.min_pages).withColumn("goes_on", F.col("n") - F.col("ends"))
    shares = ("bad", "good", "ends", "goes_on")
    whole = child.groupBy("host", "node").agg(*[F.sum(c).alias(f"all_{c}") for c in shares])
    branch = F.concat(F.lit("~"), _against("bad", "good", t.differs), _against("ends", "goes_on", t.differs))
    kept = child.join(whole, ["host", "node"]).select(F.col("host").alias("h"), F.col("node").alias("p"), F.col("segment").alias("s"), branch.alias("branch"))
    met = rows.join(kept, (F.col("host") == F.col("h")) & (F.col("node") == F.col("p")) & (F.col("segment") == F.col("s")), "left")
    token = F.when(F.col("segment").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
    return met.withColumn("node", F.concat("node", token)).drop("h", "p", "s", "branch", "segment")


def judge(df: DataFrame, rules: list[Rule], tree: Tree = Tree(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page.

    Null urls and urls without `://` have an empty host and path, no rule, and are judged as pages
    of the empty host. Repeated rows count as often as they appear. Templates need labelled pages to
    be rejected: where no rule fits any page, all are allowed. Other columns are ignored. An empty
    table gives an empty result."""
    host, path = parts(F.col(f"`{url_col}`"))
    named = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = named.withColumn("_rule", rule_of(rules, F.col("host"), F.col("path")))
    rows = ruled.select(
        "page_id", "host", "path", F.col("_rule.text").alias("rule"), F.col("_rule.verdict").alias("decided"),
        F.when(F.col("_rule.verdict") == "block", 1).otherwise(0).alias("bad"), F.when(F.col("_rule.verdict") == "allow", 1).otherwise(0).alias("good"),
        F.split(F.regexp_replace("path", "^/", ""), "/").alias("segments"), F.lit("").alias("node"),
    )
    rows = materialize(rows, "pages")
    bad, good = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = bad / (bad + good) if bad + good else 0.0
    done, level = [], 0
    while not rows.isEmpty():
        # a node with too few pages left has no branch below
        left = F.size("segments") - level
        few = rows.where(left > 0).groupBy("host", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= tree.min_pages)
        many = few.select(F.col("host").alias("h"), F.col("node").alias("p"))
        met = rows.join(many, (F.col("host") == F.col("h")) & (F.col("node") == F.col("p")), "left")
        going = F.col("h").isNotNull() & (left > 0)
        done.append(materialize(met.where(~going).withColumn("node", F.concat("node", F.repeat(F.lit("/*"), F.greatest(left, F.lit(0))))).drop("h", "p"), "leaves"))
        rows = materialize(_grown(met.where(going).drop("h", "p"), level, tree), "tree")
        level += 1
    rows = reduce(DataFrame.unionByName, done) if done else rows
    smoothed = lambda towards: (F.sum("bad") + tree.weight * towards) / (F.sum("bad") + F.sum("good") + tree.weight)
    rejected = rows.groupBy("host", "node").agg(smoothed(prior).alias("purity"), smoothed(min(prior, 0.5)).alias("own"), F.sum(F.col("bad") + F.col("good")).alias("labelled"))
    # the prior alone rejects nothing, however high it is
    rejected = rejected.where((F.col("labelled") > 0) & (F.col("purity") >= tree.threshold) & (F.col("own") >= tree.threshold))
    rejected = rejected.select(F.col("host").alias("h"), F.col("node").alias("p"), "purity")
    met = rows.join(rejected, (F.col("host") == F.col("h")) & (F.col("node") == F.col("p")), "left")
    verdict = F.coalesce("decided", F.when(F.col("purity").isNotNull(), "block").otherwise("allow"))
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("node").alias("template"), "purity")


def keep_allowed(df: DataFrame, rules: list[Rule], tree: Tree = Tree(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of df that judge() allows."""
    verdicts = judge(df, rules, tree, id_col, url_col).where("verdict = 'block'").select(F.col("page_id").alias("_blocked")).distinct()
    return without(df, "_blocked").join(verdicts, F.col(f"`{id_col}`") == F.col("_blocked"), "left_anti")
