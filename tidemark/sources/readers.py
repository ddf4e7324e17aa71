"""Readers with declared schemas: bad fields become null, bad rows are told apart, and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw measurements as text, before coercion.
OBSERVATION_CSV = "DATE string, PATIENT string, ENCOUNTER string, CODE string, DESCRIPTION string, VALUE string, UNITS string, TYPE string"
ENCOUNTER_CSV = "Id string, START string, STOP string, PATIENT string, ENCOUNTERCLASS string"
CASE_CSV = "AGE double, DIFFERENTIAL_DIAGNOSIS string, SEX string, PATHOLOGY string, EVIDENCES string, INITIAL_EVIDENCE string"
RECORD_JSON = "patient_id string, reference_date string, observations array<struct<name:string,value:string,date:string,unit:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A headed CSV by a declared schema; only ``columns`` are parsed."""
    frame = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)
    return frame.select(*columns) if columns else frame


def csv_found(spark: SparkSession, base: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A headed CSV that is named ``base``, ``base.csv`` or ``base.txt``, whichever is there."""
    return csv(spark, f"{base}{{,.csv,.txt}}", schema, columns)


def last_json_line(text: Column) -> Column:
    """The last line of a text that is a JSON object; null for none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^\{.*\}$"))
    return F.trim(F.try_element_at(lines, F.lit(-1)))


def age_in_years(born: Column, at: Column) -> Column:
    """Whole years of 365.25 days between two dates."""
    return F.floor(F.datediff(at, born) / 365.25).cast("int")


def records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entity records in JSON, one document a file or an array of them, or one a line; field names may use known synonyms.

    Names are matched without regard to case, as is Spark's rule, so synonyms that differ in case only are one.
    """
    names = ("patient_id", "patient", "id")
    item = "struct<name:string,observation:string,type:string,value:string,date:string,timestamp:string,time:string,unit:string>"
    schema = ", ".join(f"{n} string" for n in names) + f", reference_date string, observations array<{item}>"
    frame = spark.read.option("multiLine", not lines).schema(schema).json(path)
    entity = first_filled(*[F.col(c) for c in names])
    items = F.transform(
        "observations",
        lambda o: F.struct(
            first_filled(o["name"], o["observation"], o["type"]).alias("name"),
            o["value"].alias("value"),
            first_filled(o["date"], o["timestamp"], o["time"]).alias("date"),
            o["unit"].alias("unit"),
        ),
    )
    return frame.select(entity.alias("patient_id"), "reference_date", items.alias("observations"))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def literal_list(text: Column, element: str = "string") -> Column:
    """A list written with single or double quotes (``['a', "b"]``) as an array; null where it does not parse."""
    return F.from_json(text, f"array<{element}>", {"allowSingleQuotes": "true"})


def typed_literal(text: Column) -> Column:
    """A struct of ``value``, a variant of what a literal in single or double quotes says, and ``problem``, the kind of error.

    Kinds: ``null``, ``empty``, ``not a literal`` for what does not parse; ``value`` is null then. ``True``, ``False`` and
    ``None`` are read as they are meant. What follows a whole literal is not looked at.
    """
    plain = F.trim(text)
    inner = F.replace(F.replace(plain, F.lit('"'), F.lit("\uE000")), F.lit("'"), F.lit('"'))  # single quotes become double ones, double ones are kept apart
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    value = F.coalesce(F.try_parse_json(plain), F.try_parse_json(F.replace(single, F.lit("\uE000"), F.lit('\\"'))))
    kind = F.when(text.isNull(), "null").when(plain == "", "empty").when(value.isNull(), "not a literal")
    return F.struct(F.when(kind.isNull(), value).alias("value"), kind.alias("problem"))


def literal_field(literal: Column, path: str, kind: str) -> Column:
    """A struct of ``value``, the field at ``path`` of a ``typed_literal`` as a ``kind``, and ``problem``: its own, ``missing`` or ``wrong type``."""
    raw, value = F.try_variant_get(literal["value"], path, "variant"), F.try_variant_get(literal["value"], path, kind)
    problem = F.coalesce(literal["problem"], F.when(raw.isNull() | F.is_variant_null(raw), "missing").when(value.isNull(), "wrong type"))
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def measurement_items(record: DataFrame) -> DataFrame:
    """``entity, ts, kind, value, unit`` and ``problem`` for each item of entity records; ``problem`` names what is wrong with it."""
    item = record.select(F.col("patient_id").alias("entity"), F.explode_outer("observations").alias("o"))
    value = F.expr("try_cast(o.value AS double)")
    ts = F.coalesce(F.expr("try_to_timestamp(o.date)"), F.expr("try_to_timestamp(o.date, 'yyyy-MM-dd')")).cast("timestamp_ntz")
    problem = (
        F.when(F.col("o").isNull(), "no measurement")
        .when(F.coalesce(F.trim("o.name"), F.lit("")) == "", "no name")
        .when(F.col("o.value").isNull(), "no value")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "value is not a finite number")
        .when(ts.isNull(), "date is not a date")
    )
    return item.select("entity", ts.alias("ts"), F.trim("o.name").alias("kind"), value.alias("value"), F.trim(F.coalesce("o.unit", F.lit(""))).alias("unit"), problem.alias("problem"))
