"""Read queries over document-like tables: latest records, dashboards, history, directories, counters, routed context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import rank_within


def latest(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The latest row of each key (ties: the largest ``tie``), as a maximum, so that no key's rows meet in one task."""
    others = [c for c in rows.columns if c not in (key, ts, tie)]
    best = rows.groupBy(key).agg(F.max(F.struct(ts, tie, *others)).alias("_m"))
    return best.select(key, *[F.col(f"_m.{c}").alias(c) for c in (ts, tie, *others)])


def recent(rows: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    """The ``n`` latest rows of each key, numbered from the latest one."""
    return rank_within(rows, [key], [F.desc(ts), F.desc(tie)]).where(F.col("rank") <= n)


def with_counts(people: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """``people`` with how many ``rows`` each has; 0 for none. Rows are counted before they are joined."""
    return people.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def history_union(parts: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """``entity, type, ts, ref, detail``: the ``n`` latest of each type for each entity, in one table."""
    out = None
    for kind, rows in parts.items():
        one = recent(rows, "entity", "ts", "ref", n).select("entity", F.lit(kind).alias("type"), "ts", "ref", "detail")
        out = one if out is None else out.unionByName(one)
    return out


def documents(entities: DataFrame, key: str, sections: dict[str, tuple[DataFrame, list[Column], int]]) -> DataFrame:
    """One nested document for each entity: ``entities`` with an array of structs for each section.

    A section is its rows (with the column ``key``), their order and the most that are kept of each entity; the order should
    decide between any two. Each section is cut before its shuffle, so no entity gathers more than the limits add up to;
    entities without rows have empty arrays.
    """
    out = entities
    for name, (rows, order, most) in sections.items():
        fields = [c for c in rows.columns if c != key]
        kept = rank_within(rows, [key], order, "_rank").where(F.col("_rank") <= most)
        item = F.struct("_rank", F.struct(*fields).alias("item"))
        lists = kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def directory(
    entries: DataFrame,
    place: str | None = None,
    text: str | None = None,
    specialty: str | None = None,
    synonyms: dict[str, tuple[str, ...]] | None = None,
    least_rating: float | None = None,
    most_price: float | None = None,
    text_columns: tuple[str, ...] = ("name", "specialty", "city", "region"),
    place_columns: tuple[str, ...] = ("city", "region"),
) -> DataFrame:
    """Entries that meet all facets given. A place without entries is left out of account, and ``matched_place`` is false then."""
    kept = entries

    def holds(columns: tuple[str, ...], word: str) -> Column:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))
        return found

    if text:
        kept = kept.where(holds(text_columns, text))
    if specialty:
        wanted = {specialty.lower(), *(s.lower() for s in (synonyms or {}).get(specialty.lower(), ()))}
        kept = kept.where(F.lower("specialty").isin(*wanted))
    if least_rating is not None:
        kept = kept.where(F.col("rating") >= least_rating)
    if most_price is not None:
        kept = kept.where(F.col("price") <= most_price)
    if place:
        here = kept.withColumn("matched_place", holds(place_columns, place))
        any_here = here.agg(F.coalesce(F.max("matched_place"), F.lit(False)).alias("_any"))
        return here.join(F.broadcast(any_here)).where(F.col("matched_place") | ~F.col("_any")).drop("_any")
    return kept.withColumn("matched_place", F.lit(True))


def routed(messages: DataFrame, routes: dict[str, str], text: str = "text") -> DataFrame:
    """``messages`` with ``intents``: names of the routes whose pattern occurs, in order, or ``general`` for none."""
    found = F.filter(F.array(*[F.when(F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(p), F.lit(n)) for n, p in routes.items()]), lambda x: x.isNotNull())
    return messages.withColumn("intents", F.when(F.size(found) > 0, F.concat_ws(",", found)).otherwise("general"))


def same_text(column: Column | str, text: str) -> Column:
    """Whether a column is a text without regard to case; the text is taken as it is, not as a pattern."""
    return F.lower(column) == F.lit(text.lower())


def with_status(rows: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """Rows of a status; all for none or ``all``."""
    return rows if status in (None, "", "all") else rows.where(F.col(column) == status)


def applications(people: DataFrame, status: str | None = None, role: str = "doctor") -> DataFrame:
    """Rows of ``people`` with a role and a status, with the names of who verified and who rejected them, numbered from the newest.

    ``people``: ``id, name, role, status, verified_by, rejected_by, created``.
    """
    asked = with_status(people.where(F.col("role") == role), status)
    named = people.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    for by in ("verified_by", "rejected_by"):
        asked = asked.join(named, F.col(by) == F.col("_id"), "left").withColumnRenamed("_name", f"{by}_name").drop("_id")
    return asked.select("id", "name", "status", "created", "verified_by_name", "rejected_by_name")


def section(rows: DataFrame, key: str, line: Column, order: list[Column], most: int, between: str = "\n") -> DataFrame:
    """``key, text``: the first ``most`` lines of each key in an order, as one text."""
    lined = rank_within(rows.select(key, line.alias("_line"), *[c.alias(f"_o{i}") for i, c in enumerate(order)]), [key], [F.col(f"_o{i}") for i in range(len(order))], "_rank").where(F.col("_rank") <= most)
    return lined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_rank", "_line"))).alias("_all")).select(key, F.concat_ws(between, F.transform("_all", lambda x: x["_line"])).alias("text"))


def assembled(requests: DataFrame, summary: DataFrame, sections: dict[str, DataFrame], patterns: dict[str, str], general: tuple[str, ...], titles: dict[str, str], key: str = "entity") -> DataFrame:
    """``requests`` (``id, key, text``) with ``context``: the summary and those sections that the text asks for, in their order.

    A request that asks for none has the sections in ``general``. Sections (``key, text``) are left out where they are empty.
    """
    asks = {n: F.lower(F.coalesce("text", F.lit(""))).rlike(p) for n, p in patterns.items()}
    none = F.lit(True)
    for c in asks.values():
        none = none & ~c
    flagged = requests.select("id", key, *[(c | (none if n in general else F.lit(False))).alias(f"_asks_{n}") for n, c in asks.items()])
    out = flagged.join(summary.select(key, F.col("text").alias("_summary")), key, "left")
    for n, rows in sections.items():
        out = out.join(rows.select(key, F.col("text").alias(f"_text_{n}")), key, "left")
    parts = [F.when(F.col(f"_asks_{n}") & (F.coalesce(f"_text_{n}", F.lit("")) != ""), F.concat(F.lit(f"\n### {titles[n]}:\n"), F.col(f"_text_{n}"))) for n in sections]
    return out.select("id", key, F.concat_ws("\n", "_summary", *parts).alias("context"))


def alerts(signal_rows: DataFrame) -> DataFrame:
    """One alert for each abnormal or worsening signal, with its level."""
    level = F.when(F.col("severity") == "HIGH", "critical").when(F.col("abnormality").isin("LOW", "HIGH"), "warning").when(F.col("worsening"), "notice")
    return signal_rows.select("entity", "kind", level.alias("level"), F.concat_ws(" ", "kind", F.lower("abnormality"), F.lower("trend")).alias("message")).where("level is not null")
