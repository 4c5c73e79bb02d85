from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from tidemark.llm import turnrepair as tr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def best_by_trying(initials, faults):
    """The least (cost, audit) over every choice of edits with at most two inserts a gap."""
    new = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    for gaps in itertools.product(new, repeat=len(initials) + 1):
        for kept in itertools.product("DKua", repeat=len(initials)):
            cost, audit, roles = 3 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
            for choice, initial, fault, gap in zip(kept, initials, faults, gaps[1:]):
                if choice == "D":
                    cost, audit = cost + 4, audit + "D"
                elif fault in (tr.BLANK, tr.COPY):
                    break
                else:
                    cost += (3 if choice != "K" else 0) + (3 if fault == tr.CUT else 0)
                    audit += "K" if choice == "K" else "R"
                    roles += initial if choice == "K" else choice
                cost, audit, roles = cost + 3 * len(gap), audit + "I" * len(gap), roles + gap
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def by_table(initials, faults):
    """The same by a plain table of the least (cost, audit) to each place after each turn."""
    nexts = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def grown(ways):
        for _ in range(2):
            for q, (cost, audit) in list(ways.items()):
                way = (cost + 3, audit + "I")
                ways[nexts[q]] = min(ways.get(nexts[q], way), way)
        return ways

    ways = grown({0: (0, "")})
    for initial, fault in zip(initials, faults):
        after = {}
        for q, (cost, audit) in ways.items():
            more = 3 if fault == tr.CUT else 0
            options = [(q, cost + 4, audit + "D")]
            if fault not in (tr.BLANK, tr.COPY):
                options.append((nexts[q], cost + 3 + more, audit + "R"))
                if (q, initial) in keeps:
                    options.append((keeps[q, initial], cost + more, audit + "K"))
            for to, *way in options:
                after[to] = min(after.get(to, tuple(way)), tuple(way))
        ways = grown(after)
    return min(ways[q] for q in (0, 3) if q in ways)


def test_every_short_conversation_equals_trying_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2):
        for initials in itertools.product("sua?", repeat=n):
            for faults in itertools.product(range(4), repeat=n):
                want = best_by_trying(initials, faults)
                assert tr.search("".join(initials), bytes(faults), 0, tr.ENDS) == want
                assert by_table(initials, faults) == want
    for _ in range(6):
        initials, faults = rng.choices("sua?", k=3), rng.choices(range(4), k=3)
        assert tr.search("".join(initials), bytes(faults), 0, tr.ENDS) == best_by_trying(initials, faults)


@pytest.mark.parametrize("run", [1, 3, 7, 10_000])
def test_long_conversations_and_runs(run, monkeypatch):
    monkeypatch.setattr(tr, "RUN", run)
    rng = random.Random(run)
    for n in [*range(12), 40, 41, 300]:
        for _ in range(6):
            initials = rng.choices("sua?", weights=[1, 5, 5, 1], k=n)
            faults = rng.choices(range(4), weights=[6, 1, 1, 2], k=n)
            repair = tr.Repair()
            for initial, fault in zip(initials, faults):
                repair.add(initial, fault)
            assert repair.end() == by_table(initials, faults)


def test_no_way():
    assert tr.search("", b"", tr.USER, (tr.SYSTEM,)) is None


def plain(rows):
    """The contract on a list of rows, in plain Python."""
    turns, out = {}, {}
    for conv, turn, role, text in rows:
        out[conv] = None
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        turns.setdefault(conv, []).extend([row] * (2 if kind == 3 else 1))
    for conv in out:
        some = sorted(
            turns.get(conv, []),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()),
        )
        seen, faults = set(), []
        for _, role, text in some:
            bare = text.rstrip(WHITE)
            if not bare:
                faults.append(tr.BLANK)
            elif (role, text) in seen:
                faults.append(tr.COPY)
            else:
                faults.append(tr.FINE if bare[-1] in ".!?" else tr.CUT)
            seen.add((role, text))
        initials = [r[1][:1] for r in some]
        cost, audit = by_table(initials, faults)
        left, done = list(some), []
        for letter in audit:
            row = left.pop(0) if letter != "I" else (None, "", "")
            roles = [r[0][:1] for r in done]
            made = "user" if not roles or roles[-1] != "u" else "assistant"
            if letter != "D":
                done.append((row[1] if letter == "K" else made, row[2]))
        numbers = [r[0] for r in some if r[0] is not None]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in (tr.BLANK, tr.COPY, tr.CUT)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest(),
        )
    return out


NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def facts(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def odd_rows():
    rng = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "what", "", " \n", "é. ", None, "a.b?c "]) or None
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_odd_rows_equal_plain_python_and_sql(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = facts(tr.audit_conversations(table, tr.damaged(table)))
    assert got == plain(rows)
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    found = con.execute(tr.OP12_SQL)
    names = [c[0] for c in found.description]
    sql = {r[names.index("conv_id")]: tuple(r[names.index(n)] for n in NAMES) for r in found.fetchall()}
    assert sql == got


def test_dropped_conversation_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(conv, 0, "user", "x.")], SCHEMA)
    got = facts(tr.audit_conversations(table, tr.damaged(table)))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert tr.audit_conversations(table.limit(0), tr.damaged(table.limit(0))).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "user", "d")]
    turns = spark.createDataFrame(rows, SCHEMA)
    found = tr.facts(turns)
    got = tr.repaired_turns(turns, found).orderBy("position").collect()
    assert found.first().audit == "KIKKD"
    assert [(r.edit, r.role, r.text) for r in got] == [
        ("K", "user", "a."), ("I", "assistant", ""), ("K", "user", "b."), ("K", "assistant", "c.")
    ]


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert facts(tr.op12(spark, SF)) == plain(rows)
