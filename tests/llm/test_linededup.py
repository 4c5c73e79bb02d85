from __future__ import annotations

import random

import duckdb
from tidemark.llm import linededup


def run(docs, **options):
    rows = linededup.mark_lines(docs, **options).collect()
    return {(r.row.doc_id, r.row.text): (r.kept_text, r.n_lines, r.n_dropped) for r in rows}, rows


def filler(rng, n=40):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_variable_fields_are_one_template(make_docs):
    rng = random.Random(1)
    own = [filler(rng) for _ in range(20)]
    rows = [(i, f"{own[i]}\nPosted on day {i} by user u{i}@x.org\n{own[i]} end") for i in range(6)]
    long = "the server named {} could not be reached from the host at this very time"
    rows += [(10 + i, f"{own[6 + i]}\n{long.format(w)}") for i, w in enumerate(("ape", "bee", "cat", "dog"))]
    rows += [(20, own[15] + "\nOnly two here now"), (21, own[16] + "\nOnly two here now")]
    got, _ = run(make_docs(rows))
    for i in range(6):
        assert got[rows[i]] == ((rows[i][1], 3, 0) if i == 0 else (f"{own[i]}\n{own[i]} end", 3, 1))
    for i in range(6, 10):
        assert got[rows[i]][2] == (0 if i == 6 else 1)
    assert got[rows[10]][2] == got[rows[11]][2] == 0


def test_copies_are_left_to_document_dedup(make_docs):
    rng = random.Random(2)
    text = "\n".join(filler(rng, 9) for _ in range(8))
    rows = [(i, text) for i in range(5)]
    got, _ = run(make_docs(rows))
    assert all(n == 0 and kept == text for kept, _, n in got.values())


def test_numbers_short_lines_and_odd_rows(make_docs):
    rng = random.Random(3)
    own = [filler(rng) for _ in range(12)]
    rows = [(i, f"{own[i]}\n{i} {i + 1} {i + 2} {i + 3}\nend\n") for i in range(6)]
    rows += [(6, None), (7, ""), (8, "\n\n"), (None, own[8]), (0, rows[0][1]), (9, "w" * 200_000 + " 1")]
    docs = make_docs(rows).withColumnRenamed("lang", "line").withColumnRenamed("source", "template")
    got, all_rows = run(docs)
    assert len(all_rows) == len(rows) and all(n == 0 for _, _, n in got.values())
    assert got[(6, None)] == (None, 0, 0) and got[(7, "")] == ("", 1, 0)
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert linededup.drop_lines(docs.limit(0)).count() == 0


def test_hot_template(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, filler(rng, 12) + ("\nall rights are reserved here" if i % 2 else "")) for i in range(3000)]
    got, _ = run(make_docs(rows))
    assert sum(n for _, _, n in got.values()) == 1499


def test_equal_rows_are_one_document(make_docs):
    rng = random.Random(5)
    rows = [(1, filler(rng) + "\nseen in two texts"), (2, filler(rng) + "\nseen in two texts")]
    got, _ = run(make_docs(rows + [rows[1]] * 3))
    assert all(n == 0 for _, _, n in got.values())


def test_every_family_of_a_leaf_is_found(make_docs):
    rng = random.Random(6)
    own = [filler(rng) for _ in range(40)]
    clean = "the server named in this contract will be moved to another city next summer"
    long = "the server named {} could not be reached from the host at this time"
    pairs = "the server named {} could not be reached from {} host at this time"
    dear = "a list of things we never thought could be so very dear"
    rows = [(0, own[0] + "\n" + clean + "\n" + dear)]  # the smallest id, so it stands for the leaf
    rows += [(i, own[i] + "\n" + long.format(w)) for i, w in enumerate(("ape", "bee", "cat", "dog"), 1)]
    one = "\n".join(f"a list of {w} that stands in a single document only today" for w in ("ape", "bee", "cat"))
    rows += [(8, own[8] + "\n" + one), (9, own[9] + "\n" + one.split("\n")[0].replace("ape", "dog"))]
    rows += [(10, own[10] + "\n" + pairs.format("eel", "every"))]
    got, _ = run(make_docs(rows))
    lost = {r[0]: got[r][2] for r in rows}
    assert lost == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 8: 0, 9: 0, 10: 1}


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    found = con.execute(linededup.OP5_SQL)
    names = [c[0] for c in found.description]
    rows = [dict(zip(names, r)) for r in found.fetchall()]
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows), key=repr)


def by_operator(docs):
    rows = linededup.mark_lines(docs).collect()
    return sorted(((r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in rows), key=repr)


def test_operator_equals_its_sql_on_null_ids_families_and_short_lines(make_docs):
    rng = random.Random(7)
    own = [filler(rng) for _ in range(60)]
    long = "the server named {} could not be reached from {} host at this time"
    short = "please {} us now"
    rows = [(0, own[0] + "\nthe server named in this contract will be moved to another city\n" + short.format("call"))]
    rows += [(i, own[i] + "\n" + long.format(w, "the")) for i, w in enumerate(("ape", "bee", "cat", "dog"), 1)]
    rows += [(i, own[i] + "\n" + long.format("eel", w)) for i, w in enumerate(("any", "one", "no"), 5)]
    rows += [(i, own[i] + "\n" + short.format(w)) for i, w in enumerate(("write", "call", "phone", "call"), 10)]
    rows += [(i, own[i] + "\nshared by three and one of them is without id") for i in (20, 21)]
    rows += [(None, own[22] + "\nshared by three and one of them is without id"), (None, None), (None, "")]
    rows += [(30, own[30] + "\nold 1 line of days"), (30, own[31] + "\nold 2 line of days"), (30, own[32])]
    rows += [(i, own[40] + "\n" + own[41] + f"\nnumber {i}") for i in range(40, 45)]
    got = by_operator(make_docs(rows))
    assert got == by_sql(make_docs(rows))
    dropped = {i: n for i, _, _, n in got if i is not None}
    assert dropped[20] == dropped[21] == 1 and dropped[2] == dropped[7] == 1
    assert dropped[44] == 0


def test_random_templates_equal_sql(make_docs):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta"]
    for _ in range(3):
        rows = []
        for i in range(60):
            lines = [filler(rng, 12)] + [
                " ".join(["start", "of", "line", *rng.choices(words[:2], k=rng.choice([1, 5, 6]))])
                for _ in range(rng.randint(0, 4))
            ]
            rows.append((None if i == 9 else i, "\n".join(lines)))
        assert by_operator(make_docs(rows)) == by_sql(make_docs(rows))


def test_boilerplate_of_many_sources_goes_though_it_is_most_of_a_text(make_docs):
    rng = random.Random(9)
    kinds = [filler(rng, 10) for _ in range(4)]
    rows = [(i, filler(rng) + "\n" + kinds[i % 4]) for i in range(16)]
    rows += [(100, "own word\n" + "\n".join(kinds)), (101, rows[0][1])]
    got, _ = run(make_docs(rows))
    assert got[rows[16]][:1] == ("own word",) and got[rows[16]][2] == 4
    assert got[rows[17]][2] == 1  # only the line that three documents have


def test_no_python_in_the_plan(spark):
    plan = linededup.op5(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
