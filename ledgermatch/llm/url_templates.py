"""URL verdicts: host and path rules, then a path-template tree (DataFrame functions only).

Rules first: of the rules that fit a url (host equal or a subdomain, path begins with the
rule's), the longest decides.

The rest goes by templates learnt from the urls themselves.  Per host, the path's segments
are generalised level by level: below a template prefix a segment with fewer than
``least_count`` urls becomes ``*``: that is a variable position.  Then branches are
merged: a branch whose labelled share of bad urls does not differ significantly (two-sided
z test) from that of its siblings, or from the overall share where they have no label,
joins the common branch ``~`` of its prefix; one without labels does, too.  So a segment
has a branch of its own where there is evidence for it, however many segments there are and
however deep.  A template is rejected if its smoothed purity, (bad + m p) / (labelled + m),
reaches ``reject_at``; p is the host's share smoothed by the overall share in the same way.

The tree grows over distinct paths, one staged level at a time, until no prefix is open: one
with fewer than ``least_count`` urls or with a single path ends at once.  A level is a few
partial sums by (host, prefix, segment) and two joins with their results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.session import materialize

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LEAST_COUNT = 3
Z = 1.96
SMOOTHING = 4.0
REJECT_AT = 0.5


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after_scheme(url) -> Column:
    """What follows the first ``://``; null if there is none."""
    u = _column(url)
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u)))


def host_of(url) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(after_scheme(url), r"(?s)\A([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _order(rules) -> list:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def rule_of(host, path, rules=RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict); null if none fits.  Equally
    long rules: the first by code point."""
    host, path = _column(host), _column(path)
    found = None
    for name, start, verdict in _order(rules):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path) -> Column:
    """The path's segments (no empty ones)."""
    return F.filter(F.split(_column(path), "/"), lambda x: x != "")


def overall_share(urls: DataFrame) -> float:
    """Share of bad urls among the labelled ones, smoothed by one of each."""
    return urls.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.count("bad") + 2)).first()[0]


def _apart(mine, bad, others, others_bad, overall: float, z: float) -> Column:
    """Whether a branch's share of bad urls differs from its siblings', or from the overall
    share where these have no label."""
    pooled = F.when(others > 0, (others_bad + bad) / F.greatest(others + mine, F.lit(1))).otherwise(F.lit(overall))
    spread = pooled * (1 - pooled) * (1 / F.greatest(mine, F.lit(1)) + F.when(others > 0, 1 / F.greatest(others, F.lit(1))).otherwise(F.lit(0.0)))
    gap = bad / F.greatest(mine, F.lit(1)) - F.when(others > 0, others_bad / F.greatest(others, F.lit(1))).otherwise(F.lit(overall))
    return (mine > 0) & (gap * gap > z * z * spread)


def templates(urls: DataFrame, least_count: int = LEAST_COUNT, z: float = Z) -> DataFrame:
    """``urls``: columns host, path and bad (1, 0 or null: no label).  Returns the same rows
    with ``template``, the generalised and merged path (``/`` between segments)."""
    overall = overall_share(urls)
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    paths = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    now = materialize(paths.select("*", segments("path").alias("rest"), F.lit("").alias("template")), "url-paths")
    done = [now.where(F.size("rest") == 0).select("host", "path", "template")]
    now = now.where(F.size("rest") > 0)
    while not now.isEmpty():
        # prefixes with too few urls, or one path only, need no further level
        prefix = now.groupBy("host", "template").agg(F.count(F.lit(1)).alias("p_paths"), F.sum("n").alias("p_n"),
                                                     F.sum("labelled").alias("p_l"), F.sum("bad").alias("p_b"))
        prefix = materialize(prefix, "url-prefixes")
        at = now.join(prefix, ["host", "template"])
        alone = F.when(_apart(F.col("p_l"), F.col("p_b"), F.lit(0), F.lit(0), overall, z), F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise(
            F.repeat(F.lit("/~"), F.size("rest")))
        ends = F.when(F.col("p_n") < least_count, F.repeat(F.lit("/*"), F.size("rest"))).when(F.col("p_paths") == 1, alone)
        at = materialize(at.select("host", "path", "n", "labelled", "bad", "rest", "template", ends.alias("ends")), "url-level")
        done.append(at.where("ends is not null").select("host", "path", F.concat("template", "ends").alias("template")))
        now = at.where("ends is null").drop("ends").withColumn("seg", F.get("rest", F.lit(0)))
        stats = now.groupBy("host", "template", "seg").agg(*sums).where(F.col("n") >= least_count)
        kept = materialize(stats, "url-segments")
        # siblings: the kept branches of the prefix, less the branch itself
        around = kept.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        apart = _apart(F.col("labelled"), F.col("bad"), F.col("l") - F.col("labelled"), F.col("b") - F.col("bad"), overall, z)
        named = materialize(kept.join(around, ["host", "template"]).select("host", "template", "seg", F.when(apart, F.col("seg")).otherwise(F.lit("~")).alias("as")), "url-branches")
        now = now.join(named, ["host", "template", "seg"], "left").select(
            "host", "path", "n", "labelled", "bad", F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"),
            F.concat("template", F.lit("/"), F.coalesce("as", F.lit("*"))).alias("template"))
        now = materialize(now, "url-paths")
        done.append(now.where(F.size("rest") == 0).select("host", "path", "template"))
        now = now.where(F.size("rest") > 0)
    found = materialize(reduce(DataFrame.unionByName, done), "url-found")
    rows = urls.drop("template")
    return rows.join(found, ["host", "path"]).select(*rows.columns, "template")


def purities(templated: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, template, n, labelled, purity): smoothed share of bad urls."""
    t = materialize(templated.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "url-templates")
    overall = overall_share(templated)
    m = F.lit(float(smoothing))
    hosts = t.groupBy("host").agg(((F.sum("bad") + m * F.lit(overall)) / (F.sum("labelled") + m)).alias("p"))
    return t.join(hosts, "host").select("host", "template", "n", "labelled", ((F.col("bad") + m * F.col("p")) / (F.col("labelled") + m)).alias("purity"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          reject_at: float = REJECT_AT, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template and purity.

    A url that a rule decides is also a labelled example (block: bad) for the templates.
    Defined results: null url or one without ``://`` has empty host and path, no rule fits
    it, and it is judged by the template of the empty host.  Repeated rows stay."""
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    ruled = slim.withColumn("__lm_r", rule_of("host", "path", rules))
    ruled = ruled.select("page_id", "host", "path", F.col("__lm_r.rule").alias("rule"), F.col("__lm_r.verdict").alias("__lm_v"))
    ruled = materialize(ruled.withColumn("bad", F.when(F.col("__lm_v") == "block", 1).when(F.col("__lm_v") == "allow", 0)), "url-rules")
    t = templates(ruled, **options)
    p = purities(t).select(F.col("host").alias("__lm_h"), F.col("template").alias("__lm_t"), "purity")
    out = t.join(p, (F.col("host") == F.col("__lm_h")) & (F.col("template") == F.col("__lm_t")))
    own = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("__lm_v", own).alias("verdict"), "template", "purity")


__all__ = ["after_scheme", "host_of", "path_of", "rule_of", "segments", "templates", "purities", "judge"]
