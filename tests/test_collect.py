"""Collection: JSON shapes, flattening, upserts, links, streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import lifecycle as lc
from tidemark.sources.postings import OVERWRITTEN, read_postings, split_rejects
from tidemark.sources.tables import read_table, write_table
from tidemark.streaming.collect import compact, current_tables, rejected, start_collecting


def card(i, **more):
    base = {
        "id": str(i),
        "name": f"posting {i}",
        "area": {"id": "1", "name": "Town"},
        "salary_range": {"from": 100, "to": 200, "currency": "USD", "gross": True},
        "salary": {"from": 1, "to": 2, "currency": "RUR"},
        "employer": {"id": "9", "name": "Firm", "alternate_url": "u", "trusted": True},
        "schedule": {"id": "fullDay", "name": "x"},
        "experience": {"id": "noExperience", "name": "none"},
        "employment": {"id": "full", "name": "x"},
        "professional_roles": [{"id": "96", "name": "dev"}, 5],
        "published_at": "2026-08-24T11:03:17+0300",
        "archived": False,
    }
    return base | more


@pytest.fixture()
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    page = {
        "items": [
            card(1),
            card(2, salary=None, salary_range=None, employer=None),
            card(3, salary_range=None, salary={"from": 2000, "currency": "EUR"}),
            "junk",
        ]
    }
    (folder / "01-page.json").write_text(json.dumps(page))
    full = card(
        4,
        description="<p>Text</p>",
        key_skills=[{"name": "Python"}, {"name": "n8n"}, {"name": ""}, 42, "Rust", {"name": "python"}],
        work_format=[{"id": "REMOTE"}],
    )
    (folder / "02-card.json").write_text(json.dumps(full))
    (folder / "03-list.json").write_text(json.dumps([card(5, employer={"id": "8"}), card("x"), None]))
    return str(folder)


def test_shapes_and_flattening(spark, landed):
    good, rejects = split_rejects(read_postings(spark, landed))
    rows = {r["posting_id"]: r for r in good.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rejects.count() == 1
    assert (rows[1]["salary_from"], rows[1]["salary_from_base"]) == (100, 9000)
    assert rows[1]["employer_id"] == 9 and rows[1]["employer"]["trusted"] is True
    assert rows[2]["salary_from"] is None and rows[2]["employer"] is None
    assert rows[3]["salary_from_base"] == 196000
    assert rows[4]["skills"] == ["Python", "n8n", "Rust"]
    assert rows[4]["is_remote"] and rows[4]["is_detailed"] and not rows[1]["is_detailed"]
    assert rows[5]["employer"] is None
    assert [r["id"] for r in rows[1]["roles"]] == ["96"]
    assert str(rows[1]["published_at"]) == "2026-08-24 08:03:17"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text("\n".join(json.dumps(card(i)) for i in range(5)))
    assert read_postings(spark, str(path), json_lines=True).count() == 5


def test_broken_text_is_rejected_with_its_place(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text(json.dumps(card(1)) + '\n{"id": \n' + json.dumps(card(2)))
    good, rejects = split_rejects(read_postings(spark, str(path), json_lines=True))
    assert sorted(r["posting_id"] for r in good.collect()) == [1, 2]
    assert [r["seq"]["file"].rsplit("/", 1)[1] for r in rejects.collect()] == ["lines.jsonl"]
    (tmp_path / "half.json").write_text('{"items": [{"id": 1}, ')
    good, rejects = split_rejects(read_postings(spark, str(tmp_path / "half.json")))
    assert (good.count(), rejects.count()) == (0, 1)


def _batch(spark, tmp_path, name, cards):
    path = tmp_path / name
    path.write_text(json.dumps(cards))
    return read_postings(spark, str(path))


def _upsert(spark, target, batch, day):
    now = F.lit(f"2026-09-0{day}").cast("timestamp")
    return lc.upsert_postings(target, batch, OVERWRITTEN, now)


def test_upsert_twice_counts_insert_and_update(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.POSTINGS)
    batch = _batch(spark, tmp_path, "a.json", [card(1), card(1, name="later")])
    counts = lc.upsert_counts(empty, batch).first()
    assert tuple(counts) == (2, 1, 1)
    rows = _upsert(spark, empty, batch, 1).collect()
    assert [r["title"] for r in rows] == ["later"]


def test_short_copy_keeps_description_but_overwrites_with_null(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.POSTINGS)
    full = _batch(spark, tmp_path, "full.json", [card(1, description="long text")])
    short = _batch(spark, tmp_path, "short.json", [card(1, salary_range=None, salary=None)])
    first = _upsert(spark, empty, full, 1)
    row = _upsert(spark, first, short, 2).first()
    assert row["description"] == "long text" and row["salary_from"] is None
    assert row["fetched_at"].day == 2 and row["detail_fetched_at"].day == 1
    # the other way round: the full card arrives second
    row = _upsert(spark, _upsert(spark, empty, short, 1), full, 2).first()
    assert row["description"] == "long text" and row["detail_fetched_at"].day == 2


def test_repeated_batch_changes_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.POSTINGS)
    batch = _batch(spark, tmp_path, "a.json", [card(1), card(2)])
    once = _upsert(spark, empty, batch, 1)
    again = _upsert(spark, once, batch, 1)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_employers_skills_links(spark, tmp_path):
    batch = _batch(
        spark,
        tmp_path,
        "a.json",
        [
            card(1, key_skills=[{"name": "- Docker,"}, {"name": "Docker"}]),
            card(2, key_skills=[]),
            card(3, key_skills=[{"name": "docker"}, {"name": "Go"}], employer={"id": "9", "name": "New"}),
        ],
    )
    known = spark.createDataFrame([(9, "Old", None, False, None)], schemas.EMPLOYERS).withColumn(
        "first_seen_at", F.lit("2020-01-01").cast("timestamp")
    )
    employer = lc.upsert_employers(known, batch, F.lit("2026-01-01").cast("timestamp")).first()
    assert employer["employer_name"] == "New" and employer["first_seen_at"].year == 2020

    skills = spark.createDataFrame([("go", "GO")], schemas.SKILLS)
    got = {r["skill_name"]: r["display_name"] for r in lc.upsert_skills(skills, batch).collect()}
    assert got == {"go": "GO", "docker": "- Docker,"}

    links = spark.createDataFrame([(1, "old"), (2, "stays"), (7, "other")], schemas.LINKS)
    pairs = {tuple(r) for r in lc.replace_links(links, batch).collect()}
    assert pairs == {(1, "docker"), (2, "stays"), (3, "docker"), (3, "go"), (7, "other")}
    report = lc.batch_report(spark.createDataFrame([], schemas.POSTINGS), batch).first()
    assert report["employers_touched"] == 3 and report["skills_linked"] == 4


def test_tombstones_and_queue(spark):
    rows = [(1, "2026-01-01", None, False), (2, None, None, False), (3, "2026-01-03", "2026-01-04", False)]
    postings = spark.createDataFrame(rows, "posting_id bigint, p string, d string, archived boolean").select(
        "posting_id",
        F.col("p").cast("timestamp").alias("published_at"),
        F.col("d").cast("timestamp").alias("detail_fetched_at"),
        "archived",
    )
    assert [r["posting_id"] for r in lc.pending_details(postings).collect()] == [1, 2]
    gone = spark.createDataFrame([(1,), (1,)], "posting_id bigint")
    after = lc.apply_tombstones(postings, gone)
    assert [r["posting_id"] for r in lc.pending_details(after).collect()] == [2]
    assert {r["posting_id"]: r["archived"] for r in after.collect()} == {1: True, 2: False, 3: False}


def test_cascade(spark):
    postings = spark.createDataFrame([(1, 9), (2, 8), (3, None)], "posting_id bigint, employer_id bigint")
    links = spark.createDataFrame([(1, "a"), (2, "b")], schemas.LINKS)
    chunks = spark.createDataFrame([(1,), (3,)], "posting_id bigint")
    employers = spark.createDataFrame([(9,), (8,)], "employer_id bigint")
    rest = lc.delete_employers(employers.where("employer_id = 9"), employers, postings, links, chunks)
    assert [sorted(r[0] for r in t.collect()) for t in rest] == [[8], [2, 3], [2], [3]]


def test_table_versions(spark, tmp_path):
    root = str(tmp_path / "tables")
    assert read_table(spark, root, "skills").count() == 0
    write_table(spark.createDataFrame([("a", "A")], schemas.SKILLS), root, "skills")
    table = read_table(spark, root, "skills")
    # a table may be rewritten from itself
    more = table.unionByName(spark.createDataFrame([("b", "B")], schemas.SKILLS))
    write_table(more, root, "skills")
    assert read_table(spark, root, "skills").count() == 2


def test_stream_equals_batch_and_reruns_change_nothing(spark, landed, tmp_path):
    root, checkpoint = str(tmp_path / "root"), str(tmp_path / "checkpoint")

    def collect():
        start_collecting(spark, landed, root, checkpoint).awaitTermination()
        return {
            name: sorted(map(str, frame.drop("fetched_at", "detail_fetched_at", "first_seen_at").collect()))
            for name, frame in current_tables(spark, root).items()
        }

    first = collect()
    assert collect() == first
    compact(spark, root)
    assert collect() == first

    batch, _ = split_rejects(read_postings(spark, landed))
    whole = lc.upsert_postings(spark.createDataFrame([], schemas.POSTINGS), batch, OVERWRITTEN)
    want = sorted(map(str, whole.drop("fetched_at", "detail_fetched_at").collect()))
    assert first["postings"] == want

    # a later file changes one posting and adds another
    (tmp_path / "landed" / "09-late.json").write_text(json.dumps([card(1, name="renamed"), card(6)]))
    later = collect()
    assert len(later["postings"]) == len(first["postings"]) + 1
    assert rejected(spark, root).count() == 1
    titles = {r["posting_id"]: r["title"] for r in current_tables(spark, root)["postings"].collect()}
    assert titles[1] == "renamed"
    compact(spark, root)
    assert collect() == later


def test_compacting_twice_or_after_a_break_loses_nothing(spark, landed, tmp_path):
    root, checkpoint = str(tmp_path / "root"), str(tmp_path / "checkpoint")

    def collect(*names):
        for name in names:
            rows = [card(i) for i in range(int(name), int(name) + 2)] + [card("x")]
            (tmp_path / "landed" / f"{name}.json").write_text(json.dumps(rows))
        start_collecting(spark, landed, root, checkpoint).awaitTermination()

    def state():
        tables = {n: sorted(map(str, t.collect())) for n, t in current_tables(spark, root).items()}
        return tables, rejected(spark, root).count()

    collect("10")
    want = state()
    for _ in range(3):
        compact(spark, root)
        assert state() == want
    # a run cut off before its postings: the others are there, yet do not count
    collect("20")
    want = state()
    tables = current_tables(spark, root)
    for name in ("employers", "skills"):
        write_table(tables[name], root, name, run=1)
    assert state() == want
    compact(spark, root)
    assert state() == want
    collect("30")
    want = state()
    compact(spark, root)
    compact(spark, root)
    assert state() == want and want[1] == 4
    # batches that two snapshots hold are gone
    assert len(list((tmp_path / "root" / "changes").glob("run=*"))) == 1


def test_a_table_never_replaces_its_own_input(spark, tmp_path):
    root = str(tmp_path / "a b")
    write_table(spark.createDataFrame([("a", "A")], schemas.SKILLS), root, "skills", run=3)
    with pytest.raises(ValueError, match="is read by"):
        write_table(read_table(spark, root, "skills"), root, "skills", run=3)
    write_table(spark.createDataFrame([("b", "B")], schemas.SKILLS), root, "skills", run=3)
    assert read_table(spark, root, "skills").first()["skill_name"] == "b"


def test_one_bad_record_does_not_stop_the_load(spark, tmp_path):
    rows = [card(1), card(2, salary_range={"from": 3_000_000_000, "to": 1}), card("?")]
    good, rejects = split_rejects(_batch(spark, tmp_path, "a.json", rows))
    assert [r["posting_id"] for r in good.collect()] == [1]
    assert sorted(r["problem"] for r in rejects.collect()) == ["no usable id", "salary out of range"]
