"""URL filtering by rules and by trust that spreads over host links, in DataFrame operations only.

Hosts of pages that a rule allows are trusted seeds, hosts of pages that a rule blocks are blocked seeds. Personalised
PageRank carries trust along the links between hosts; distrust starts at the blocked seeds and goes against the links, to
those that link to them. A host is blocked if distrust makes up more than a threshold of what it has of both. The number of
rounds follows from the damping and from how much of all trust may be left unspread.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<[a-z][^>]*?\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path: from there up to `?`, `#` or
    the end. Both are empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _SMALL), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host and path) that fits, as struct(verdict, rule), or null. A rule fits its host
    and all subdomains, if the path starts with the rule's. Of equally long ones the first wins."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found, F.lit(None).cast("struct<verdict:string,rule:string>"))


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """(host, html) -> links between different hosts with their counts (src, dst, n), summed before the shuffle."""
    to = F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)))
    links = pages.where((F.col("host") != "") & F.col(html).isNotNull()).select(F.col("host").alias("src"), to.alias("to"))
    links = links.select("src", F.translate("to", _UPPER, _SMALL).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which the rest of the series, which is at most damping**rounds of all trust, is within the tolerance."""
    return max(1, ceil(log(tolerance) / log(damping)))


def propagate(links: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int = 29, written_every: int = 4) -> DataFrame:
    """Trust and distrust by personalised PageRank: links (src, dst, n), seeds (kind 0 trusted or 1 blocked, host, share)
    -> (kind, host, score). Kind 1 goes against the links. Shares of a kind add up to 1; what reaches a host without
    further links ends there.

    Links with a null host, or of a host with itself, must not be among them; repeated links add up; without links the seeds
    keep their own part of their shares; without seeds there are no scores. Scores of a round are made by a partial
    aggregation before the shuffle and written every few rounds, so that a host which a third of all links lead to is a row
    for each task."""
    both = links.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(links.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    both = scratch.save(both, "links")
    out = scratch.save(both.groupBy("kind", "host").agg(F.sum("n").alias("all")), "degrees")
    both = scratch.save(both.join(out.hint("merge"), ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("part")), "edges")
    start = seeds.select("kind", "host", F.col("share").alias("score"))
    rest = start.withColumn("score", F.col("score") * (1 - damping))
    if both.isEmpty():
        return rest
    score = start
    for k in range(1, rounds + 1):
        moved = both.join(score.hint("merge"), ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        score = rest.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % written_every == 0 or k == rounds:
            score = scratch.save(score, f"score-{k}")
    return score


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, damping: float = 0.85, tolerance: float = 0.01) -> DataFrame:
    """page_id, host, path, rule (the one that fits, else null), verdict (the rule's, else that of the host) and the host's
    trust and distrust, for each row.

    A null url, or one without `://`, has an empty host and path: no rule fits it and it is allowed. A null html has no
    links; links that name no host are within their own. Hosts without trust and distrust are allowed. Repeated rows are judged alike, each for itself; an empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("fit.verdict") == "allow", 0).when(F.col("fit.verdict") == "block", 1)
    seeds = rows.select(kind.alias("kind"), "host").where("kind is not null and host <> ''").groupBy("kind", "host").agg(F.count("*").alias("n"))
    seeds = scratch.save(seeds, "seeds")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = seeds.join(total.hint("merge"), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("share"))
    score = propagate(host_links(rows, "html"), seeds, scratch, damping, rounds_for(damping, tolerance))
    score = score.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("score"))), F.lit(0.0)).alias("distrust"))
    score = scratch.save(score, "hosts")
    scratch.drop(*[n for n in scratch.names if n != "hosts"])
    rows = rows.drop("html").join(score.hint("merge"), "host", "left")
    blocked = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(blocked, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
