"""Column rules on hand-computed cases."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fields as f
from tidemark.functions import text as t
from tidemark.functions.vector import cosine


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def json_value(text: str):
    return F.try_parse_json(F.lit(text))


#: Characters that the rule for skill names takes off at both ends, and some that it leaves.
TAKEN = list("-–—•·,.;:/\\()[]{}\"'«»") + [" ", "\t", "\n", "\u00a0", "\u2003"]
LEFT = list("*#+„“!?&%_@")


def plain_name(raw: str) -> str:
    """The rule in plain Python: edges off, white space single, caseless, yo folded."""
    begin, end = 0, len(raw)
    while begin < end and raw[begin] in TAKEN:
        begin += 1
    while end > begin and raw[end - 1] in TAKEN:
        end -= 1
    return " ".join(raw[begin:end].split()).casefold().replace("ё", "е")


def test_norm_name_on_generated_names(spark):
    cores = ["", "go", "Ёлка", "GROSSE STRASSE", "straße", "x.y", "a - b", "c\t\u00a0 d", "1С"]
    names = [
        before + core + after
        for core in cores
        for before, after in product(["", *TAKEN, *LEFT, "- (", "* "], ["", "+", ".", "»)", " ;", "#,"])
    ]
    rows = spark.createDataFrame([(n,) for n in names], "raw string")
    got = rows.select("raw", t.norm_name(F.col("raw")).alias("name")).collect()
    assert {r.raw: r.name for r in got} == {n: plain_name(n) for n in names}


def test_ordered_dedupe_keeps_first_spelling(spark):
    names = ["Python", " n8n ", "", "python", None, "Учёт", "учет", "- Docker,", "Docker"]
    column = F.array(*[F.lit(n).cast("string") for n in names])
    assert one(spark, t.ordered_dedupe(column)) == ["Python", "n8n", "Учёт", "- Docker,", "Docker"]


def test_base_currency_rounds_half_to_even(spark):
    """Amounts times rates against decimal arithmetic; an unknown currency has no amount."""
    currencies = [None, "", "???", *f.RATES, *(c.lower() for c in f.RATES)]
    cases = list(product([None, 0, 1, 7, 25, 50, 150, 2_500, 99_999], currencies))

    def want(amount, currency):
        if amount is None:
            return None
        if not currency:
            return amount
        rate = f.RATES.get(currency.upper())
        if rate is None:
            return None
        return int((Decimal(amount) * Decimal(str(rate))).to_integral_value(ROUND_HALF_EVEN))

    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a int, c string")
    got = rows.select("i", f.to_base_currency(F.col("a"), F.col("c")).alias("x")).collect()
    assert {cases[r.i]: r.x for r in got} == {c: want(*c) for c in cases}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-08-24T11:03:17+0300", "2026-08-24 08:03:17"),
        ("2026-08-24T08:03:17Z", "2026-08-24 08:03:17"),
        (" 2026-08-24T11:03:17+03:00 ", "2026-08-24 08:03:17"),
        ("2026-08-24", "2026-08-24 00:00:00"),
        ("2026", None),
        ("not a date", None),
        ("", None),
        (None, None),
        ("2026-13-40T00:00:00Z", None),
    ],
)
def test_parse_ts(spark, raw, want):
    got = f.parse_ts(F.lit(raw).cast("string")).cast("string")
    assert one(spark, got) == want


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ('{"work_format":[{"id":"REMOTE","name":"x"}]}', True),
        ('{"work_format":[],"schedule":{"id":"remote"}}', True),
        ('{"schedule":{"name":" Удалённая работа "}}', True),
        ('{"schedule":{"id":"fullDay","name":"Полный день"}}', False),
        ('{"work_format":"remote"}', False),
        ("{}", False),
    ],
)
def test_remote(spark, record, want):
    r = json_value(record)
    assert one(spark, f.is_remote(f.at(r, "$.work_format"), f.at(r, "$.schedule"))) is want


@pytest.mark.parametrize(
    ("raw", "whole", "text", "flag", "true"),
    [
        ("12", 12, None, None, True),
        ('" 12 "', 12, "12", None, True),
        ('"3.7"', None, "3.7", None, True),
        ("3.7", 3, None, None, True),
        ("true", None, None, True, True),
        ("false", None, None, False, False),
        ("null", None, None, None, False),
        ('""', None, None, None, False),
        ("0", 0, None, None, False),
        ("[]", None, None, None, False),
        ('{"a":1}', None, None, None, True),
    ],
)
def test_coercions(spark, raw, whole, text, flag, true):
    v = json_value(raw)
    row = spark.range(1).select(
        f.as_whole(v).alias("w"), f.as_text(v).alias("t"), f.as_flag(v).alias("f"), f.truthy(v).alias("b")
    ).first()
    assert tuple(row) == (whole, text, flag, true)


def test_salary_object_wins_as_a_whole(spark):
    r = json_value('{"salary_range":{"from":null,"to":5},"salary":{"from":1,"to":2}}')
    assert one(spark, f.as_whole(f.at(f.pick_salary(r), "$.from"))) is None
    r = json_value('{"salary_range":null,"salary":{"from":1}}')
    assert one(spark, f.as_whole(f.at(f.pick_salary(r), "$.from"))) == 1


def test_experience(spark):
    for raw, rank, label in [
        ("noExperience", 0, "Без опыта"),
        ("moreThan6", 3, "Более 6 лет"),
        ("other", None, "other"),
        (None, None, "не указан"),
        ("", None, "не указан"),
    ]:
        c = F.lit(raw).cast("string")
        assert one(spark, f.experience_rank(c)) == rank
        assert one(spark, f.experience_label(c)) == label


def test_snippet(spark):
    assert one(spark, t.snippet(F.lit("  abc  "), 3)) == "abc"
    assert one(spark, t.snippet(F.lit("ab cd"), 3)) == "ab…"
    assert one(spark, t.snippet(F.lit(""), 3)) == ""


def test_limit_clamp():
    assert [f.clamp_limit(n) for n in (-3, 0, 1, 50, 51)] == [1, 1, 1, 50, 51]
    assert [f.clamp_limit(n, 50) for n in (-3, 50, 51)] == [1, 50, 50]


def test_cosine(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ([3, 4], [4, 3], [0, 0]))
    assert one(spark, cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, cosine(a, z)) == 0.0


def test_dedupe_works_each_name_out_once(spark):
    # thousands of names: a pass over all names for each of them would not end here
    names = ["  Ab", "aB ", None, "", "Ё", "е", "c"] + [f"w{i % 300}" for i in range(3000)]
    table = spark.createDataFrame([(names,), (None,), ([],)], "names array<string>")
    assert [r[0] for r in table.select(t.ordered_dedupe(F.col("names"))).collect()] == [
        ["Ab", "Ё", "c"] + [f"w{i}" for i in range(300)], [], []
    ]
