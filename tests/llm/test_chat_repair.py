import itertools
import random
import re

import duckdb

from quillsieve.llm import chat_repair
from quillsieve.llm.chat_repair import INITIALS, cheapest_repair, parse_block, repair_conversations, repaired_turns
from quillsieve.llm.queries import ORACLE, op13_conversation_repair

KINDS = [chr(97 + k) for k in range(12)]


def exhaustive(kinds, inserts=2):
    """All edits of a few rows, with up to `inserts` insertions in each gap, by the definition."""
    gaps = [g for k in range(inserts + 1) for g in itertools.product("ua", repeat=k)]
    best = None
    for edits in itertools.product("KDua", repeat=len(kinds)):
        cost, roles, letters = 0, [], []
        for kind, e in zip(kinds, edits, strict=True):
            initial, fault = divmod(ord(kind) - 97, 3)
            if e != "D" and fault == 1:
                break
            cost += {"K": 0, "D": 2}.get(e, 1) + (5 if e != "D" and fault == 2 else 0)
            roles.append(INITIALS[initial] if e == "K" else "" if e == "D" else e)
            letters.append(e if e in "KD" else "R")
        else:
            for put in itertools.product(gaps, repeat=len(kinds) + 1):
                n = sum(map(len, put))
                if best and cost + 5 * n > best[0]:
                    continue
                if re.fullmatch("(s?(ua)+)?", "".join("".join(g) + r for g, r in zip(put, [*roles, ""], strict=True))):
                    found = (cost + 5 * n, "".join("I" * len(g) + e for g, e in zip(put, [*letters, ""], strict=True)))
                    best = found if best is None else min(best, found)
    return best


def test_repairs_equal_all_edits():
    rng = random.Random(3)
    for kinds in [*map("".join, itertools.product(KINDS, repeat=1)), *("".join(rng.choices(KINDS, k=2)) for _ in range(60)), *("".join(rng.choices(KINDS, k=3)) for _ in range(25))]:
        assert cheapest_repair(kinds) == exhaustive(kinds), kinds
    assert cheapest_repair("") == (0, "") and repaired_turns("", "") == []


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(4)
    some = ["".join(rng.choices(KINDS, weights=[3, 1, 1, 9, 1, 1, 9, 1, 1, 1, 1, 1], k=rng.randint(1, 40))) for _ in range(40)]
    want = [parse_block(k)[("b", "a")] if ("b", "b") not in parse_block(k) else min(parse_block(k)[("b", "a")], parse_block(k)[("b", "b")]) for k in some]
    for size in (1, 3, 8):
        monkeypatch.setattr(chat_repair, "BLOCK", size)
        assert [cheapest_repair(k) for k in some] == want
    for k, (_, audit) in zip(some, want, strict=True):
        roles = "".join(INITIALS[(ord(k[t["at"]]) - 97) // 3] if t["role"] is None else t["role"][0] for t in repaired_turns(k, audit))
        assert re.fullmatch("(s?(ua)+)?", roles) and len(audit) - audit.count("I") == len(k)


def test_a_very_long_conversation():
    rng = random.Random(5)
    kinds = "".join(rng.choices(KINDS, weights=[1, 1, 1, 40, 1, 1, 40, 1, 1, 1, 1, 1], k=30_000))
    cost, audit = cheapest_repair(kinds)
    assert len(audit) - audit.count("I") == 30_000 and cost > 0


def made(n=400, seed=8):
    rng = random.Random(seed)
    texts = ["ok.", "ok.", "no end", "", " \t\n", "a?b!", "\x1c", "x\x85", "日本。", "日本!", "end. \r\n", None, "long " * 3000]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"]
    rows = [(rng.choice([*range(25), None, -3]), rng.choice([*range(12), None]), rng.choice(roles), rng.choice(texts), "extra") for _ in range(n)]
    return [*rows, *rows[:20], (90, None, "user", None, ""), (91, 7, "system", "hm.", ""), *((92, k, "user", "same.", "") for k in range(30))]


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, fault string"
    for name, rows in (("odd", made()), ("none", [])):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{tmp_path}/{name}/conversations.parquet/*.parquet'")
        out = op13_conversation_repair(spark, f"{tmp_path}/{name}")
        result = con.execute(ORACLE["op13_conversation_repair"])
        at = [[x[0] for x in result.description].index(c) for c in out.columns]
        key = lambda r: tuple(map(str, r))
        got, want = sorted([tuple(r) for r in out.collect()], key=key), sorted([tuple(r[i] for i in at) for r in result.fetchall()], key=key)
        assert got == want and len(got) == len({r[0] for r in rows})


def test_repaired_turns_of_undamaged_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Lost."), (3, 0, "system", "Be good."), (3, 1, "user", "Well")]
    got = {r.conv_id: (r.cost, r.audit, [tuple(t) for t in r.repaired]) for r in repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (2, "KDK", [("user", "Hi."), ("assistant", "Yes.")]), 2: (2, "D", []), 3: (4, "DD", [])}
