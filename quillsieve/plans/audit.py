"""The audit of a corpus: rule packs over sections and references, one issues table, scores and a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, apply_rules
from ..functions.sql import run
from ..operators import citations, lines, packs, sequences, structure

#: A pack takes the tables it needs by name and returns (doc_id, pos, rule_id, severity).
Pack = Callable[[dict[str, DataFrame]], DataFrame]


def rows(rules: list[Rule], table: str = "sections", pos: str = "pos") -> Pack:
    """A pack of rules on single rows of a table: one scan."""
    return lambda t: apply_rules(t[table], rules, ["doc_id", pos]).select("doc_id", F.col(pos).alias("pos"), "rule_id", "severity")


def ordered(op, severity: int, table: str = "sections") -> Pack:
    """A pack of one sequence operator; all share the window (doc_id, pos)."""
    return lambda t: op(t[table]).select("doc_id", "pos", "rule_id", F.lit(severity).alias("severity"))


def references(t: dict[str, DataFrame]) -> DataFrame:
    """Bibliography rules over the parts of references."""
    parts = citations.with_parts(t["refs"])
    return apply_rules(parts, packs.REFERENCE_RULES, ["doc_id", "ref_pos"]).select("doc_id", F.col("ref_pos").alias("pos"), "rule_id", "severity")


def over_prose(pack: Pack) -> Pack:
    """A pack that passes code sections over, also as neighbours of others."""
    return lambda t: pack(t | {"sections": lines.prose(t["sections"])})


def list_items(t: dict[str, DataFrame]) -> DataFrame:
    """List rules; sections have style and left_indent."""
    return apply_rules(run(packs.LIST_LEVEL, x=t["sections"]), packs.LIST_RULES, ["doc_id", "pos"])


#: Packs that pass code over, to be named in `more`; `captions` needs row_count and pages, `lists` needs style and left_indent.
PROSE_PACKS: dict[str, Pack] = {
    "layout": over_prose(rows(packs.LAYOUT_RULES)),
    "lists": over_prose(list_items),
    "jumps": over_prose(ordered(sequences.heading_jumps, 3)),
    "reversals": over_prose(ordered(sequences.heading_reversals, 2)),
    "captions": over_prose(ordered(sequences.missing_captions, 2)),
}

PACKS: dict[str, Pack] = {
    "formatting": rows(packs.FORMATTING_RULES),
    "integrity": rows(packs.INTEGRITY_RULES),
    "headings": ordered(sequences.heading_jumps, 4),
    "numbering": ordered(sequences.figure_numbering, 3),
    "references": references,
}


def audit(tables: dict[str, DataFrame], use: list[str] | None = None, more: dict[str, Pack] | None = None) -> DataFrame:
    """Issues (doc_id, pos, pack, rule_id, severity) of the named packs, all by default, and of packs of the caller's own.

    Packs that need a table that isn't given are left out. Nothing is collected; each pack is one branch of a union."""
    known = PACKS | (more or {})
    found = [pack(tables).select("doc_id", "pos", F.lit(name).alias("pack"), "rule_id", "severity") for name, pack in known.items() if (use is None or name in use) and ("refs" in tables or name != "references")]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def scores(issues: DataFrame) -> DataFrame:
    """Issues and score of each document: 10, 5, 2 and 1 points from critical to low."""
    points = F.when(F.col("severity") == 5, 10).when(F.col("severity") == 4, 5).when(F.col("severity") == 3, 2).when(F.col("severity") == 2, 1).otherwise(0)
    return issues.groupBy("doc_id").agg(F.count("*").alias("issues"), F.sum(points).alias("score"), F.count_if(F.col("severity") >= 4).alias("high"))


def review(tables: dict[str, DataFrame], mode: str = "packs", reviewer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`packs`: rule packs; `local`: text rules and an outside reviewer (sections -> issues, see reviewer.outside_reviewer); `hybrid`: packs, and the reviewer
    for the sections that the packs have no issue of."""
    text = lambda t: apply_rules(t["sections"], packs.TEXT_RULES, ["doc_id", "pos"])
    if mode == "packs":
        return audit(tables)
    own = text(tables).select("doc_id", "pos", F.lit("text").alias("pack"), "rule_id", "severity") if mode == "local" else audit(tables)
    if reviewer is None:
        return own
    left = tables["sections"] if mode == "local" else tables["sections"].join(own.select("doc_id", "pos").distinct().hint("merge"), ["doc_id", "pos"], "left_anti")
    return own.unionByName(reviewer(left).select("doc_id", "pos", F.lit("reviewer").alias("pack"), "rule_id", "severity"))


def presence_issues(sections: DataFrame) -> DataFrame:
    """Documents without headings or abstract, for use as a pack of its own."""
    return structure.presence(sections)
