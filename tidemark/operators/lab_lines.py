"""Lines of laboratory reports to measurements: layout, units, plausibility."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``name: value unit (range) flag`` and ``name value unit``; the second group is the number.
LINE = r"^\s*([A-Za-z][A-Za-z0-9 /()-]*?)\s*[:=]?\s+([0-9]+(?:\.[0-9]+)?)\s*([^\s()\[\]0-9][^\s()\[\]]*)?"
#: Two numbers joined by a slash.
PRESSURE = r"(?i)^\s*blood pressure\s*[:=]?\s*([0-9]{2,3})\s*/\s*([0-9]{2,3})\s*([A-Za-z]*)"
#: Part of a kind's name, part of a unit's name, factor, decimals, and the kind's unit.
CONVERSIONS = (
    ("cholesterol", "mmol", 38.67, 1, "mg/dL"),
    ("triglyceride", "mmol", 88.57, 1, "mg/dL"),
    ("bilirubin", "umol", 0.0585, 2, "mg/dL"),
    ("creatinine", "umol", 0.0113, 2, "mg/dL"),
)
#: Glucose from mmol, glycated haemoglobin from mmol/mol, and the unit of cell counts.
GLUCOSE, A1C, CELLS = 18.0182, (0.09148, 2.152), "10³/µL"
#: Layouts of a line of name, value and unit, tried in order; composite pressures; a value at a line's start.
LAYOUTS = (
    r"(?i)^\s*\|?\s*([A-Za-z0-9\s/().\-+]{2,45}?)\s*[:=\t|]+\s*([<>]?\s*[\d,]+(?:\.\d+)?)\s*([A-Za-z%µ³/\^0-9\-*]*)",
    r"(?i)^\s*\|?\s*([A-Za-z0-9\s/().\-+]{2,45}?)\s{2,}([<>]?\s*[\d,]+(?:\.\d+)?)\s*([A-Za-z%µ³/\^0-9\-*]*)",
    r"(?i)^\s*([A-Za-z0-9\s/().\-+]{2,40}?)\s+([<>]?\s*[\d,]+(?:\.\d+)?)\s+([A-Za-z%µ³/\^0-9\-*]+)",
)
PRESSURES = (
    r"(?i)(?:blood\s*pressure|bp|b\.p\.|nibp)[:\s]+(\d{2,3})\s*[/\\-]\s*(\d{2,3})",
    r"(?i)(\d{2,3})\s*[/\\-]\s*(\d{2,3})\s*mm\s*hg",
    r"(?i)systolic[/_]diastolic[:\s]+(\d{2,3})\s*[/\\-]\s*(\d{2,3})",
)
VALUE_FIRST = r"^\s*([<>]?\s*[\d,]+(?:\.\d+)?)\s*([A-Za-z%µ³/\^0-9\-]*)"
#: Added before rounding: halves go up, whatever the product's last binary digit.
HALF = 3.7e-8
#: Bounds within which a value of a kind is plausible.
BOUNDS = {"glucose": (10.0, 1000.0), "cholesterol": (20.0, 1000.0), "triglycerides": (10.0, 5000.0), "bilirubin": (0.0, 50.0), "creatinine": (0.05, 30.0), "platelets": (1.0, 2000.0), "systolic": (40.0, 300.0), "diastolic": (20.0, 200.0)}


def parsed(lines: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """``id, kind, value, unit`` of every measurement in a line; pressures give two, lines without a measurement none."""
    line = F.coalesce(F.col(line_col), F.lit(""))
    group = lambda pattern, n: F.regexp_extract(line, pattern, n)
    item = lambda kind, value, unit: F.struct(kind.alias("kind"), value.alias("value"), unit.alias("unit"))
    number = lambda c: F.when(c != "", c.cast("double"))
    two = F.array(item(F.lit("systolic"), number(group(PRESSURE, 1)), group(PRESSURE, 3)), item(F.lit("diastolic"), number(group(PRESSURE, 2)), group(PRESSURE, 3)))
    one = F.array(item(F.lower(F.trim(group(LINE, 1))), number(group(LINE, 2)), group(LINE, 3)))
    items = F.when(group(PRESSURE, 1) != "", two).when(group(LINE, 2) != "", one)
    return lines.select(F.col(id_col).alias("id"), F.explode(items).alias("m")).select("id", "m.kind", "m.value", "m.unit")


def _unit_key(unit: Column) -> Column:
    return F.replace(F.replace(F.lower(F.coalesce(unit, F.lit(""))), F.lit("µ"), F.lit("u")), F.lit("μ"), F.lit("u"))


def converted(items: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """``items`` in the one unit of their kind, each rule rounded to its own decimals; other kinds keep theirs.

    Kinds without a rule take the unit that ``units`` (``kind, unit``, a dictionary of kinds, each once) gives them, whatever
    is written; their values stay. Cells given in lakhs or per microlitre are counted in thousands, leukocytes from 100 on if their unit says so or they
    are more than 120; glycated haemoglobin over 25 or in mmol/mol becomes %.
    """
    key, kind, value = _unit_key(F.col("unit")), F.lower("kind"), F.col("value")
    rounded = lambda v, n: F.round(v + HALF, n)
    in_unit = lambda *parts: F.array_contains(F.array(*[key.contains(p) for p in parts]), True)
    rules = [
        (kind.contains("platelet"), F.when(in_unit("lakh", "lac"), rounded(value * 100, 1)).when(value > 3000, rounded(value / 1000, 1)), CELLS),
        (kind.contains("leukocyte"), F.when((in_unit("cumm", "mcl", "ul") | (value > 120)) & (value > 100), rounded(value / 1000, 2)), CELLS),
        (kind == "glucose", F.when(in_unit("mmol"), rounded(value * GLUCOSE, 1)), "mg/dL"),
        *[(kind.contains(k), F.when(in_unit(unit), rounded(value * factor, places)), result) for k, unit, factor, places, result in CONVERSIONS],
        (kind.contains("hba1c") | kind.contains("hemoglobin a1c"), F.when(in_unit("mmol/mol") | (value > 25), rounded(value * A1C[0] + A1C[1], 2)), "%"),
    ]
    new_value, new_unit = value, F.col("unit")
    for rule, changed, unit in reversed(rules):
        new_value, new_unit = F.when(rule, F.coalesce(changed, value)).otherwise(new_value), F.when(rule, unit).otherwise(new_unit)
    rest = [c for c in items.columns if c not in ("value", "unit")]
    if units is not None:
        ruled = F.coalesce(functools.reduce(lambda a, b: a | b, (rule for rule, _, _ in rules)), F.lit(False))
        items = items.join(units.select(F.col("kind").alias("_kind"), F.col("unit").alias("_unit")), F.col("kind") == F.col("_kind"), "left")
        new_unit = F.when(ruled, new_unit).otherwise(F.coalesce("_unit", "unit"))
    return items.select(*rest, new_value.alias("value"), new_unit.alias("unit"))


def report_items(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``doc, kind, value, unit, line, confidence``: measurements of whole reports, each kind's first one.

    ``lines`` has ``doc, no, line``; ``names`` (``alias, kind``) is a dimension of names as they are written, sent to the
    lines. A line counts in the first of three layouts whose name is known; a line that is a known name alone takes the value
    that the next line begins with, at nine tenths of the confidence. A composite pressure gives a systolic and a diastolic
    value, if plausible, before other values of these kinds. Lines are read once, each is matched with each layout once, and
    those that are dealt by ``doc`` are not shuffled again.
    """
    from pyspark.sql import Window as W

    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    number = lambda c: F.regexp_replace(c, r"[,<>\s]", "").try_cast("double")
    part = lambda pattern, n, c="line": F.regexp_extract(c, pattern, n)
    line = F.regexp_replace(F.trim(F.coalesce("line", F.lit(""))), "[\"']", "")
    after = F.lead("line").over(W.partitionBy("doc").orderBy("no"))  # the lines of one report
    cleaned = lines.select("doc", "no", line.alias("line"), F.trim(F.coalesce(after, F.lit(""))).alias("after")).where(F.length("line") >= 3)
    # all groups by one match: none of them holds the mark between them, and a line without a match stays as it is
    tried = lambda pattern: F.when(F.col("line").rlike("[0-9,]"), F.regexp_replace("line", pattern + "(?s:.*)", "$1\x01$2\x01$3"))
    pressed = F.coalesce(*[F.when(F.col("line").rlike(p), F.array(part(p, 1), part(p, 2))) for p in PRESSURES])
    pressed = F.when(F.col("line").rlike(r"\d{2}\s*[/\\-]\s*\d{2}"), pressed)  # all of them hold this
    read = cleaned.select("doc", "no", "line", "after", pressed.alias("_two"), *[tried(p).alias(f"_{i}") for i, p in enumerate(LAYOUTS)])
    option = lambda i, name, value, unit, sure, kind=None: F.struct(F.lit(i).alias("i"), name.alias("alias"), F.lit(kind).cast("string").alias("pressed"), value.alias("value"), unit.alias("unit"), F.lit(sure).alias("sure"))
    options = []
    for i in range(len(LAYOUTS)):
        groups = F.split(f"_{i}", "\x01")
        options.append(F.when(F.col(f"_{i}") != F.col("line"), option(i, key(groups[0]), number(groups[1]), groups[2], 1.0)))
    begins = F.col("after").rlike(VALUE_FIRST)
    options.append(F.when(begins, option(9, key(F.col("line")), number(part(VALUE_FIRST, 1, "after")), part(VALUE_FIRST, 2, "after"), 0.9)))
    for i, kind in enumerate(("systolic", "diastolic")):
        options.append(F.when(F.col("_two").isNotNull(), option(-1, F.lit(None).cast("string"), F.col("_two")[i].cast("double"), F.lit("mmHg"), 0.95, kind)))
    # the outer form: with the other one the optimiser matches all lines once more to see which have options
    each = read.select("doc", "no", F.explode_outer(F.array_compact(F.array(*options))).alias("o")).select("doc", "no", "o.*").where("value is not null and (pressed is not null or alias <> '')")
    known = names.select(key(F.col("alias")).alias("alias"), F.col("kind").alias("named")).distinct()
    met = each.join(F.broadcast(known), "alias", "left").where("pressed is not null or named is not null").withColumn("kind", F.coalesce("pressed", "named"))
    met = judged(met).where("pressed is null or plausible")
    once = met.groupBy("doc", "no", "pressed").agg(F.min(F.struct("i", "kind", "value", "unit", "sure")).alias("m")).select("doc", "no", "pressed", "m.*")
    first = once.groupBy("doc", "kind").agg(F.min(F.struct(F.col("pressed").isNull().alias("named"), "no", "value", "unit", "sure")).alias("m")).select("doc", "kind", "m.*")
    return converted(first).select("doc", "kind", "value", "unit", F.col("no").alias("line"), F.col("sure").alias("confidence"))


def judged(items: DataFrame) -> DataFrame:
    """``items`` with ``plausible``: within the bounds of their kind, or 0 to 10,000 where it has none."""
    from tidemark.operators.cleaning import in_range

    bounds = F.create_map(*[x for k, (low, high) in BOUNDS.items() for x in (F.lit(k), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    b = F.try_element_at(bounds, F.col("kind"))
    return items.withColumn("plausible", F.coalesce(in_range(F.col("value"), b["low"], b["high"]), F.lit(False)))
