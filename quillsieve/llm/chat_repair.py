"""Repair of conversation structure by weighted interval parsing.

A conversation is a string of rows, and the repaired one must have roles `(s?(ua)+)?`. The repair grammar is in Chomsky normal
form: its symbols are the pairs (p, q) of states of that expression, (p, q) -> (p, r) (r, q) are its binary rules, and a row
alone is kept, given another role, or deleted. A cell of the parse table stands for a span of rows and holds for each symbol
the cheapest derivation as (cost, audit), equal costs by the audit's letters; rows are closed under insertion on both sides
when they enter the table, which closes every longer span too. Cells are filled bottom-up by span length.

Spans of up to `BLOCK` rows are parsed with all their splits. As (p, q) derives a span through any of its splits, longer
spans need one: blocks are joined in pairs, pairs of blocks in pairs, and so on, so that a conversation of n rows takes a table
of n cells and not of n squared. Spark brings the rows of a conversation together and computes their faults, and a task parses the
strings of row kinds; equal blocks are parsed once.
"""

from __future__ import annotations

import functools
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are parsed with all splits of all spans.
BLOCK = 8
# The states before any turn and after a system, user or assistant turn, the turns that may follow in each, and costs.
START, SYSTEM, USER, ASSISTANT = "bsua"
FOLLOW = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows, in order of their letters from `a` on: initial s, u, a or another; each sound, to be deleted, or truncated.
INITIALS, FAULTS = "suao", 3

Cell = dict[tuple[str, str], tuple[int, str]]


def _better(cell: Cell, symbol: tuple[str, str], cost: int, audit: str) -> None:
    old = cell.get(symbol)
    if old is None or (cost, audit) < old:
        cell[symbol] = (cost, audit)


def combine(left: Cell, right: Cell) -> Cell:
    """All symbols of a span from those of its two parts."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in FOLLOW:
            found = right.get((r, q))
            if found is not None:
                _better(out, (p, q), cost + found[0], audit + found[1])
    return out


def _insertions() -> Cell:
    """The cheapest insertions alone that lead from one state to another."""
    cell: Cell = {(p, p): (0, "") for p in FOLLOW}
    one: Cell = cell | {(p, q): (INSERT, "I") for p in FOLLOW for q in FOLLOW[p] if q in NAMES}
    while (wider := combine(cell, one)) != cell:
        cell = wider
    return cell


_CLOSURE = _insertions()


def _row(kind: str) -> Cell:
    """The cell of one row, closed under insertion."""
    initial, fault = INITIALS[(ord(kind) - 97) // FAULTS], (ord(kind) - 97) % FAULTS
    cell: Cell = {(p, p): (DELETE, "D") for p in FOLLOW}
    for p, follow in FOLLOW.items():
        for q in follow:
            if fault != 1:
                more = TRUNCATED if fault == 2 else 0
                if q == initial:
                    _better(cell, (p, q), more, "K")
                if q in NAMES:
                    _better(cell, (p, q), REROLE + more, "R")
    return combine(combine(_CLOSURE, cell), _CLOSURE)


_ROWS = {chr(97 + k): _row(chr(97 + k)) for k in range(len(INITIALS) * FAULTS)}


@functools.lru_cache(1 << 16)
def parse_block(kinds: str) -> Cell:
    """The cell of all rows, from a table of all spans and splits."""
    n = len(kinds)
    table = {(i, i + 1): _ROWS[k] for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell: Cell = {}
            for cut in range(i + 1, i + size):
                for symbol, (cost, audit) in combine(table[i, cut], table[cut, i + size]).items():
                    _better(cell, symbol, cost, audit)
            table[i, i + size] = cell
    return table[0, n]


def cheapest_repair(kinds: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a string of row kinds."""
    if not kinds:
        return 0, ""
    cells = [parse_block(kinds[k : k + BLOCK]) for k in range(0, len(kinds), BLOCK)]
    while len(cells) > 1:
        cells = [combine(*x) if len(x) == 2 else x[0] for x in itertools.batched(cells, 2)]
    return min(cells[0][START, q] for q in (START, ASSISTANT) if (START, q) in cells[0])


def repaired_turns(kinds: str, audit: str) -> list[dict]:
    """For each turn of the repaired conversation the place of its row, from 0, and its role where it is another; none for an inserted one."""
    out, at = [], 0
    after = START
    for edit in audit:
        if edit == "K":
            after = INITIALS[(ord(kinds[at]) - 97) // FAULTS]
            out.append({"at": at, "role": None})
        elif edit != "D":
            after = ASSISTANT if after == USER else USER
            out.append({"at": at if edit == "R" else None, "role": NAMES[after]})
        at += edit != "I"
    return out


def _repairs(kinds: pd.Series) -> pd.DataFrame:
    found = [(k, *cheapest_repair(k)) for k in kinds]
    return pd.DataFrame({"cost": [c for _, c, _ in found], "audit": [a for *_, a in found], "turns": [repaired_turns(k, a) for k, _, a in found]})


def _clean(c: str) -> Column:
    return F.coalesce(c, F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> the same with defects, by crc32 of `conv_id:turn` modulo 20: 0 marks a row as `gone`, 1
    empties its text, 2 removes `.!?` from it, 3 repeats it (copy 1) and 4 makes it the user's. A null, in the key too, counts as
    one space; turn stays null. Other columns are left out."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", _clean("role").alias("role"), _clean("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("gone"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, and optionally copy and gone) -> a row for each conversation: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired (array of role and text).

    Rows go by turn, nulls first, then role, text and copy; of equal rows all but one are duplicates, whichever. A row's first fault counts: blank, duplicate (role and text seen
    earlier) or truncated. Nulls in role and text are one space; null conv_ids are one conversation; a role that is none of
    s, u, a by its initial can't be kept. Conversations whose rows are all `gone` have zeros and an empty audit; an empty table
    gives no rows. A conversation, which is one training example, is one row of Spark while it is repaired, however long:
    n rows take n log n steps; only its string of kinds, a character a row, goes to Python."""
    for name, value in (("copy", F.lit(0)), ("gone", F.lit(False))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    rows = rows.select("conv_id", "turn", _clean("role").alias("role"), _clean("text").alias("text"), "copy", "gone").repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.coalesce(F.nullif(F.position(F.substring("role", 1, 1), F.lit(INITIALS[:3])), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    row = F.struct("turn", "role", "text", "copy", "seen", fault.alias("fault"), initial.alias("initial"))
    grouped = rows.withColumn("seen", seen).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), row))).alias("rows"))
    faults = lambda name: F.size(F.filter("rows", lambda r: r.fault == name)).cast("long").alias(name)
    turns = F.filter(F.transform("rows", lambda r: r.turn), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    kind = lambda r: F.char(97 + FAULTS * r.initial + F.when(r.fault.isNull(), 0).when(r.fault == "truncated", 2).otherwise(1))
    initials = F.array_join(F.transform("rows", lambda r: F.substring(F.lit(INITIALS), r.initial + 1, F.lit(1))), "")
    told = grouped.select("conv_id", "rows", F.array_join(F.transform("rows", kind), "").alias("kinds"), initials.alias("initials"), gaps.alias("gaps"), *[faults(x) for x in ("blank", "duplicate", "truncated")])
    told = told.withColumn("found", F.pandas_udf(_repairs, "cost long, audit string, turns array<struct<at:int,role:string>>")("kinds"))
    at = lambda t: F.get("rows", t.at)
    repaired = F.transform("found.turns", lambda t: F.struct(F.coalesce(t.role, at(t).role).alias("role"), F.coalesce(at(t).text, F.lit("")).alias("text")))
    illegal = F.greatest(F.length("initials") - 1, F.lit(0)) - F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    return told.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), "found.cost", "found.audit", repaired.alias("repaired"))
