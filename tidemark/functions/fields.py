"""Money, time, remote work and experience rules, and coercion of loose JSON values.

Loose values are `variant` columns: the type of each value is known, so a number, a
boolean and their spellings as text can be told apart without a Python function.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, fold_case, strip

# Approximate rates to the base currency.
RATES: dict[str, float] = {
    "RUR": 1.0,
    "RUB": 1.0,
    "USD": 90.0,
    "EUR": 98.0,
    "KZT": 0.19,
    "BYR": 27.0,
    "BYN": 27.0,
    "UAH": 2.2,
    "UZS": 0.007,
    "KGS": 1.03,
    "AZN": 53.0,
    "GEL": 33.0,
}
BASE_CURRENCY = "RUR"

# Identifiers and names that mean remote work.
REMOTE_MARKERS = ("remote", "удаленная работа", "удалённая работа", "удалённо", "удаленно")

# Required experience from none to the longest, with its display label.
EXPERIENCE_ORDER = ("noExperience", "between1And3", "between3And6", "moreThan6")
EXPERIENCE_LABELS = {
    "noExperience": "Без опыта",
    "between1And3": "1–3 года",
    "between3And6": "3–6 лет",
    "moreThan6": "Более 6 лет",
}
EXPERIENCE_UNKNOWN = "не указан"


def _literal_map(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


# ------------------------------------------------------------------ loose values --


def variant_type(value: Column) -> Column:
    """Type name of a loose value; null where it is absent."""
    return F.schema_of_variant(value)


def at(value: Column, path: str) -> Column:
    """Loose value at a path; null where any step is missing."""
    return F.try_variant_get(value, path, "variant")


def _of_type(value: Column, prefix: str) -> Column:
    return F.coalesce(variant_type(value).startswith(prefix), F.lit(False))


def is_object(value: Column) -> Column:
    return _of_type(value, "OBJECT")


def is_present(value: Column) -> Column:
    """Neither absent nor a JSON null."""
    return value.isNotNull() & ~_of_type(value, "VOID")


def as_text(value: Column) -> Column:
    """Trimmed text; null for any other type and for blanks."""
    text = F.when(_of_type(value, "STRING"), F.try_variant_get(value, "$", "string"))
    return F.nullif(strip(text), F.lit(""))


def as_whole(value: Column, to: str = "bigint") -> Column:
    """Whole number from a number (fraction dropped) or its spelling; never from a boolean."""
    kind = variant_type(value)
    spelled = F.try_variant_get(value, "$", "string")
    return (
        F.when(
            kind == "STRING",
            F.when(spelled.rlike(rf"^{SPACE}*[+-]?\d+{SPACE}*$"), strip(spelled).try_cast(to)),
        )
        .when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint").try_cast(to))
        .when(
            kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
            F.try_variant_get(value, "$", "double").try_cast(to),
        )
    )


def as_flag(value: Column) -> Column:
    """A JSON boolean; null for anything else."""
    return F.when(_of_type(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))


def truthy(value: Column) -> Column:
    """Absent, null, false, zero and empty count as false, everything else as true."""
    kind = variant_type(value)
    empty = F.try_variant_get(value, "$", "string").isin("", "[]", "{}")
    return F.coalesce(
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double") != 0)
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .otherwise(~F.coalesce(empty, F.lit(False))),
        F.lit(False),
    )


def elements(value: Column) -> Column:
    """Elements of a JSON list; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


# -------------------------------------------------------------------- field rules --


def pick_salary(record: Column) -> Column:
    """The newer salary object if there is one, else the older; never mixed by field."""
    newer, older = at(record, "$.salary_range"), at(record, "$.salary")
    return F.when(is_object(newer), newer).when(is_object(older), older)


def to_base_currency(
    amount: Column, currency: Column, rates: Mapping[str, float] = RATES
) -> Column:
    """Amount in the base currency, rounded half to even; null for an unknown currency."""
    code = F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit(BASE_CURRENCY)))
    rate = F.try_element_at(_literal_map(dict(rates)), code)
    return F.rint(amount.cast("double") * rate).try_cast("int")


def parse_ts(text: Column) -> Column:
    """Timestamp from an ISO 8601 spelling; null for anything else."""
    clean = strip(text)
    clean = F.regexp_replace(clean, "Z$", "+00:00")
    clean = F.regexp_replace(clean, r"([+-]\d{2})(\d{2})$", "$1:$2")
    dated = clean.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2})")
    return F.when(dated, clean.try_cast("timestamp"))


def _says_remote(text: Column) -> Column:
    return F.coalesce(fold_case(strip(text)).isin(*REMOTE_MARKERS), F.lit(False))


def _names_remote(value: Column) -> Column:
    return _says_remote(as_text(at(value, "$.id"))) | _says_remote(as_text(at(value, "$.name")))


def is_remote(work_formats: Column, schedule: Column) -> Column:
    """Any listed work format, or else the schedule, names remote work."""
    listed = F.exists(F.coalesce(elements(work_formats), F.array()), _names_remote)
    return listed | _names_remote(schedule)


def experience_rank(col: Column, order: tuple[str, ...] = EXPERIENCE_ORDER) -> Column:
    """Position in the order of required experience; null for an unknown identifier."""
    return F.try_element_at(_literal_map({e: i for i, e in enumerate(order)}), col)


def experience_label(col: Column, labels: Mapping[str, str] = EXPERIENCE_LABELS) -> Column:
    named = F.try_element_at(_literal_map(labels), col)
    return F.coalesce(named, F.nullif(col, F.lit("")), F.lit(EXPERIENCE_UNKNOWN))


def clamp_limit(limit: int, max_limit: int | None = None) -> int:
    """At least one row; at most `max_limit` where the caller sets one."""
    return max(1, limit if max_limit is None else min(limit, max_limit))
