import hashlib
import os
import random
from itertools import product

import duckdb
import pytest

from custlens.llm import dialogue_repair as D
from custlens.llm import sql
from custlens.llm.catalog import QUERIES

SPACE = " \t\n\x0b\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_audit(kinds):
    """Shortest path over whole audits on the automaton of (s?(ua)+)?."""
    def inserted(now):
        todo = list(now)
        while todo:
            old = todo.pop()
            for x in "ua":
                new, way = NEXT.get((old, x)), (now[old][0] + 3, now[old][1] + "I")
                if new and way < now.get(new, (10**9, "")):
                    now[new] = way
                    todo.append(new)
        return now

    now = {"": (0, "")}
    for kind in kinds:
        after = {}
        for old, (cost, audit) in inserted(now).items():
            ways = [(old, cost + 4, "D")]
            if kind:
                own, cut = "?sua"[(kind - 1) // 2], 3 * ((kind - 1) % 2)
                ways += [(NEXT[old, x], cost + c + cut, e) for x, c, e in ((own, 0, "K"), ("u", 3, "R"), ("a", 3, "R")) if (old, x) in NEXT]
            for new, c, e in ways:
                after[new] = min(after.get(new, (10**9, "")), (c, audit + e))
        now = after
    now = inserted(now)
    return min(now[s] for s in ("", "a") if s in now)


def slow(rows):
    """The whole report by plain Python; rows of (conv, turn, role, text) or (conv,)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in (r for r in rows if len(r) > 1) if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            end = text.rstrip(SPACE)
            fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault - 1] += 1
            kinds.append(0 if fault in (1, 2) else 1 + 2 * ("sua".find(role[:1]) + 1 if role else 0) + (fault == 3))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = plain_audit(kinds)
        lines, i, odd = [], 0, len(audit.replace("D", "")) % 2
        for e in audit:
            role, text = ("user", "assistant")[(len(lines) - odd) % 2], ""
            if e != "I":
                role, text = own[i][1] if e == "K" else role, own[i][2]
                i += 1
            if e != "D":
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def report(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_audits_equal_the_plain_search():
    glr = D.Parser()
    for n in range(5):
        for kinds in product(range(9), repeat=n):
            assert glr.audit(bytes(kinds)) == plain_audit(kinds)
    rnd = random.Random(3)
    for _ in range(1500):
        kinds = bytes(rnd.choices(range(9), weights=[rnd.choice((0, 1, 6)) or 0.1 for _ in range(9)], k=rnd.randint(5, 80)))
        assert glr.audit(kinds) == plain_audit(kinds)
    # the stacks share tails and are few, whatever the length
    assert len(glr.nodes) < 20


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql.OP11})").fetchall()
    got = [tuple(r) for r in QUERIES["op11_glr_repair"](spark, f"/root/testdata/{sf}").select(*cols).collect()]
    assert sorted(got) == sorted(want) and got


def test_random_conversations(spark):
    rnd = random.Random(4)
    texts = ["Hi.", "What?", "well", "", " \n", "a b c!", "x ", "Hi. \t", None]
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    rows = [(conv if conv else None, rnd.choice([None, 1, 2, 3, 4, 7]), rnd.choice(roles), rnd.choice(texts)) for conv in range(150) for _ in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = slow(rows)
    assert report(D.repair_conversations(df)) == {c: v[:-1] for c, v in want.items()}
    lines = {}
    for r in sorted(D.repaired_rows(df).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {c: v[-1] for c, v in want.items() if v[-1]}


def test_damage(spark):
    import zlib
    rows = [(c, t, "assistant", f"Row {c}.{t}! ok?") for c in range(60) for t in range(4)] + [(None, None, None, None), (7, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if code <= 1 else x.translate(str.maketrans("", "", ".!?")) if code == 2 else x
        want += [(c, t, "user" if code == 4 else r, x, code != 0)] * (2 if code == 3 else 1)
    assert sorted(map(repr, map(tuple, D.damage(df).collect()))) == sorted(map(repr, want))
    assert {r[4] for r in want} == {True, False}


def test_one_conversation_holds_most_rows(spark):
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), f"t{t % 5000}" + rnd.choice(". ")) for t in range(20_000)]
    rows += [(2 + t, 0, "user", "Hi.") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got, want = report(D.repair_conversations(df)), slow(rows)
    assert got == {c: v[:-1] for c, v in want.items()}


def test_odd_tables(spark):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    schema = "conv_id string, turn long, role string, text string, there boolean, cost string, audit string, tie string"
    rows = [("a", 1, "user", "x" * 3_000_000 + ".", True, "c", "z", "t"), ("b", 1, "user", "Hi.", False, None, None, None), ("c", None, "assistant", "", None, "1", "KK", "")]
    got = report(D.repair_conversations(spark.createDataFrame(rows, schema)))
    assert got["b"] == (0, 0, 0, 0, 0, 0, "", empty) and got["c"] == (0, 1, 0, 0, 0, 4, "D", empty)
    assert got["a"][:-1] == (0, 0, 0, 0, 0, 3, "KI") and got["a"][-1] == hashlib.sha256(b"user:" + b"x" * 3_000_000 + b".\nassistant:").hexdigest()
    assert D.repair_conversations(spark.createDataFrame([], schema)).collect() == []
    assert D.repaired_rows(spark.createDataFrame([], schema)).collect() == []
