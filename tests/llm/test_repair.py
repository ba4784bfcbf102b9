"""Conversation repair against a plain recursion over all edits, and its edge cases."""

import hashlib
import random
import zlib
from functools import cache

from tarnwork.llm import repair as r

ROLES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # state: role initial: state


def every_edit(rows):
    """The least (cost, audit) of all edits of (initial, fault) rows, from the back."""

    @cache
    def best(at, state, inserted):
        tries = [(0, "")] if at == len(rows) and state in (0, 3) else []
        made = next(n for role, n in ROLES[state].items() if role != "s")
        steps = [("I", 2, at, made, inserted + 1)] if inserted < 3 else []
        if at < len(rows):
            initial, fault = rows[at]
            steps.append(("D", 3, at + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                charge = int(fault == "truncated")
                steps.append(("R", 2 + charge, at + 1, made, 0))
                if initial in ROLES[state]:
                    steps.append(("K", charge, at + 1, ROLES[state][initial], 0))
        for letter, cost, *then in steps:
            rest = best(*then)
            tries += [(cost + rest[0], letter + rest[1])] if rest else []
        return min(tries, default=None)

    return best(0, 0, 0)


def test_search_is_the_least_of_all_edits():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice("suuaat"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 9))]
        for segment in (1, 2, 3, 512):
            assert r.cheapest(rows, segment) == every_edit(tuple(rows))


def test_a_long_conversation_is_cut_without_a_change():
    rng = random.Random(6)
    rows = [(rng.choice("suuaa"), rng.choice(["", "", "truncated", "duplicate"])) for _ in range(1300)]
    assert r.cheapest(rows, 100) == r.cheapest(rows, 5000)


def test_faults_in_order():
    said = [("user", "a."), ("user", " \t"), ("user", "a."), ("user", " \t"), ("assistant", "a. "), ("user", "b")]
    assert r.faults(said) == ["", "blank", "duplicate", "blank", "", "truncated"]


def test_edge_cases(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."),  # a gap and a repeat
        (2, None, None, None), (2, 0, "", "x!"),  # nulls, an empty role
        (None, 1, "user", "a?"), (None, 2, "user", "b?"),
    ]
    table = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").selectExpr("*", "1 AS present", "'x' AS kind", "'y' AS audit")
    got = {x["conv_id"]: x for x in r.repair(table).collect()}
    one, two, none = got[1], got[2], got[None]
    assert (one["gaps"], one["duplicate"], one["cost"], one["audit"]) == (1, 1, 3, "KKKD")
    assert [m["role"] for m in one["repaired"]] == ["system", "user", "assistant"]
    assert (two["gaps"], two["blank"], two["cost"], two["audit"], two["illegal"]) == (0, 1, 6, "DD", 1)
    assert none["repaired"] and (none["cost"], none["audit"], none["illegal"]) == (2, "KR", 1)
    assert r.repair(table.where("false")).count() == 0 and r.repair_report(table.where("false")).count() == 0


def test_report_damages_as_stated(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"said {t}. " * 3) for c in range(40) for t in range(6)]
    made = {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = {1: "", 2: text.replace(".", "")}.get(kind, text)
        made.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    got = {x["conv_id"]: x for x in r.repair_report(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(3)).collect()}
    assert got.keys() == made.keys()
    for c, said in made.items():
        messages = [m[1:] for m in said]
        cost, audit = every_edit(tuple(zip([m[0][:1] for m in messages], r.faults(messages), strict=True)))
        text = "\n".join(f"{x['role']}:{x['text']}" for x in r.edited(messages, audit))
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (got,) = r.repair_report(spark.createDataFrame([(9, turn, "user", "x.")], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).collect()
    assert tuple(got)[:8] == (9, 0, 0, 0, 0, 0, 0, "") and got["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_a_conversation_of_many_rows(spark):
    rows = spark.range(20_000).selectExpr("7 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('n', id, '.') AS text")
    (got,) = r.repair(rows).collect()
    assert got["audit"] == "K" * 20_000 and got["cost"] == 0
