"""Collected postings: JSON files in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fields as f
from tidemark.functions.text import ordered_dedupe

#: Columns replaced by every newer copy of a posting.  The description and the time of
#: the full card are kept when a newer copy does not bring them.
OVERWRITTEN = (
    "title",
    "employer_id",
    "area_id",
    "area_name",
    "salary_from",
    "salary_to",
    "salary_currency",
    "salary_gross",
    "salary_from_base",
    "salary_to_base",
    "experience_id",
    "experience_name",
    "employment_id",
    "schedule_id",
    "is_remote",
    "roles",
    "url",
    "published_at",
    "created_at",
    "archived",
)


def read_records(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Raw JSON objects with their source position.

    A file (or a line, with `json_lines`) is a search page with an `items` list, a single
    object, or a list; elements that are not objects are dropped.  Large collections should
    be landed as JSON lines, which Spark can split inside a file.
    """
    raw = (
        spark.read.format("json")
        .option("singleVariantColumn", "payload")
        .option("multiLine", str(not json_lines).lower())
        .load(path)
        .select(
            "payload",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )
    return expand_records(raw)


def expand_records(raw: DataFrame) -> DataFrame:
    """Rows of `payload` (with `file` and `block`) to one row per JSON object.

    `seq` orders the copies of a posting: by file name, then by position in the file.  The
    position of a line inside its block is the order Spark reads it in.  Text that is not
    JSON leaves a row without a record, which `split_rejects` sorts out by its position.
    """
    payload = F.col("payload")
    broken = payload.isNull()
    listed = F.coalesce(
        F.try_variant_get(payload, "$.items", "array<variant>"),
        F.when(f.at(payload, "$.items").isNull(), f.elements(payload)),
        F.when(f.at(payload, "$.items").isNull(), F.array(payload)),
        F.array().cast("array<variant>"),
    )
    line = F.monotonically_increasing_id()
    return (
        raw.withColumn("line", line)
        .withColumn("broken", broken)
        .select("file", "block", "line", "broken", F.posexplode_outer(listed).alias("place", "record"))
        .where(f.is_object(F.col("record")) | F.col("broken"))
        .select(
            F.struct("file", "block", "line", "place").alias("seq"),
            "record",
        )
    )


def _employer(record: Column) -> Column:
    raw = f.at(record, "$.employer")
    employer_id = f.as_whole(f.at(raw, "$.id"))
    name = f.as_text(f.at(raw, "$.name"))
    return F.when(
        f.is_object(raw) & employer_id.isNotNull() & name.isNotNull(),
        F.struct(
            employer_id.alias("employer_id"),
            name.alias("employer_name"),
            f.as_text(f.at(raw, "$.alternate_url")).alias("url"),
            f.truthy(f.at(raw, "$.trusted")).alias("trusted"),
        ),
    )


def _roles(value: Column) -> Column:
    kept = F.filter(F.coalesce(f.elements(value), F.array().cast("array<variant>")), f.is_object)
    return F.transform(
        kept,
        lambda x: F.struct(
            F.try_variant_get(x, "$.id", "string").alias("id"),
            F.try_variant_get(x, "$.name", "string").alias("name"),
        ),
    )


def _skill_names(value: Column) -> Column:
    def name_of(item: Column) -> Column:
        return F.when(f.is_object(item), f.as_text(f.at(item, "$.name"))).otherwise(f.as_text(item))

    items = F.coalesce(f.elements(value), F.array().cast("array<variant>"))
    return ordered_dedupe(F.transform(items, name_of))


def flatten_postings(records: DataFrame) -> DataFrame:
    """Raw objects to typed rows: one projection, no Python function.

    Keeps `seq`, and carries `employer`, `skills` and `is_detailed` (the object has a
    description, even an empty one) for the upserts, and `problem` for `split_rejects`.
    """
    r = F.col("record")

    def text(path: str) -> Column:
        return f.as_text(f.at(r, path))

    typed = records.select("seq", "record", f.pick_salary(r).alias("salary")).select(
        "seq",
        "record",
        f.as_whole(f.at(F.col("salary"), "$.from"), "int").alias("salary_from"),
        f.as_whole(f.at(F.col("salary"), "$.to"), "int").alias("salary_to"),
        f.as_text(f.at(F.col("salary"), "$.currency")).alias("salary_currency"),
        f.as_flag(f.at(F.col("salary"), "$.gross")).alias("salary_gross"),
        "salary",
    )
    currency = F.col("salary_currency")
    roles = _roles(f.at(r, "$.professional_roles"))
    return typed.select(
        "seq",
        f.as_whole(f.at(r, "$.id")).alias("posting_id"),
        F.coalesce(text("$.name"), F.lit("")).alias("title"),
        _employer(r).alias("employer"),
        f.as_whole(f.at(r, "$.area.id"), "int").alias("area_id"),
        text("$.area.name").alias("area_name"),
        "salary_from",
        "salary_to",
        "salary_currency",
        "salary_gross",
        f.to_base_currency(F.col("salary_from"), currency).alias("salary_from_base"),
        f.to_base_currency(F.col("salary_to"), currency).alias("salary_to_base"),
        text("$.experience.id").alias("experience_id"),
        text("$.experience.name").alias("experience_name"),
        text("$.employment.id").alias("employment_id"),
        text("$.schedule.id").alias("schedule_id"),
        f.is_remote(f.at(r, "$.work_format"), f.at(r, "$.schedule")).alias("is_remote"),
        F.when(F.size(roles) > 0, roles).alias("roles"),
        text("$.description").alias("description"),
        text("$.alternate_url").alias("url"),
        f.parse_ts(text("$.published_at")).alias("published_at"),
        f.parse_ts(text("$.created_at")).alias("created_at"),
        f.truthy(f.at(r, "$.archived")).alias("archived"),
        _skill_names(f.at(r, "$.key_skills")).alias("skills"),
        f.is_present(f.at(r, "$.description")).alias("is_detailed"),
        _problem(r, F.col("salary")).alias("problem"),
    ).withColumn("employer_id", F.col("employer.employer_id"))


def _problem(record: Column, salary: Column) -> Column:
    """Why a record cannot be loaded; null for a good one."""

    def too_large(side: str) -> Column:
        amount = f.at(salary, side)
        return f.as_whole(amount, "decimal(38,0)").isNotNull() & f.as_whole(amount, "int").isNull()

    return (
        F.when(record.isNull(), F.lit("not JSON"))
        .when(f.as_whole(f.at(record, "$.id")).isNull(), F.lit("no usable id"))
        .when(too_large("$.from") | too_large("$.to"), F.lit("salary out of range"))
    )


def split_rejects(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be loaded, and the rest with the reason in `problem`."""
    good = flat.where(F.col("problem").isNull()).drop("problem")
    return good, flat.where(F.col("problem").isNotNull())


def read_postings(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    return flatten_postings(read_records(spark, path, json_lines))
