"""Queries on text: normal form, aliases, fuzzy words, negation, values, and lines of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import lab_lines, locations, matching, questions
from tidemark.operators.evaluation import rank_within
from tidemark.session import dealt
from tidemark.sources import roles
from tidemark.sources.readers import table
from tidemark.sources.roles import SQL


def text_normalize(spark, sf):
    return matching.prepared(table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")).select("id", F.md5("normal").alias("normal_md5"), F.size("words").alias("n_words"))


def alias_exact(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("  "), F.upper("p_name"), F.lit("!")).alias("text"))
    return matching.exact(names, roles.aliases(spark, sf))


def alias_containment(spark, sf):
    return matching.contained_in_wordings(roles.reports(spark, sf), roles.aliases(spark, sf)).groupBy("id", "code").agg(F.count("*").alias("n"), F.min("place").alias("place"))


def alias_overlap(spark, sf):
    """Distinct wordings only: what a text is matched with depends on nothing else."""
    wordings = roles.reports(spark, sf).groupBy("text").agg(F.min("id").alias("id"))
    return matching.by_overlap(wordings, roles.aliases(spark, sf))


def alias_fuzzy(spark, sf):
    """Words of documents that are near words of product names."""
    return matching.fuzzy(matching.distinct_words(table(spark, sf, "documents")), roles.aliases(spark, sf))


def alias_longest(spark, sf):
    """Where an alias lies within a longer one, the longer one stays: both words of each name are aliases here as well."""
    names = roles.aliases(spark, sf)
    single = names.select(F.element_at(F.split("alias", " "), 1).alias("alias")).distinct().select("alias", F.concat(F.lit("W_"), "alias").alias("code"))
    found = matching.contained(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("the "), "p_name").alias("text")), names.unionByName(single))
    return matching.longest(found).select("id", "code", "place", "n_alias")


def negation_scope(spark, sf):
    found = matching.contained_in_wordings(roles.reports(spark, sf), roles.aliases(spark, sf))
    return found.groupBy("id", "code").agg(F.max("negated").alias("negated"))


def polarity_counts(spark, sf):
    found = matching.contained_in_wordings(roles.reports(spark, sf), roles.aliases(spark, sf))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.count(F.when(F.col("negated"), 1)).alias("n_negated"))


def value_intensity(spark, sf):
    return roles.reports(spark, sf).select("id", text.intensity(F.col("text")).alias("intensity")).where("intensity is not null")


def _lines(spark, sf):
    kinds = ("Glucose", "Cholesterol", "Creatinine", "Platelets", "Blood Pressure", "HbA1c", "Leukocytes")
    units = ("mmol/L", "mmol/L", "umol/L", "lakhs/cumm", "mmHg", "mmol/mol", "/cumm")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    lines = table(spark, sf, "lineitem")
    number = F.col("l_quantity").cast("int")
    value = F.when((F.col("l_linenumber") - 1) % 7 == 4, F.concat((number + 100).cast("string"), F.lit("/"), (number + 40).cast("string"))).when((F.col("l_linenumber") - 1) % 7 == 6, F.concat((number * 5).cast("string"), F.lit(".0"))).otherwise(F.concat(number.cast("string"), F.lit("."), (number % 10).cast("string")))
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(pick(kinds), F.lit(": "), value, F.lit(" "), pick(units)).alias("line"))


def lab_lines_parsed(spark, sf):
    return lab_lines.parsed(_lines(spark, sf))


def unit_convert(spark, sf):
    return lab_lines.converted(lab_lines.parsed(_lines(spark, sf)))


def plausibility(spark, sf):
    judged = lab_lines.judged(lab_lines.converted(lab_lines.parsed(_lines(spark, sf))))
    return judged.groupBy("kind", "unit").agg(F.count("*").alias("n"), F.count(F.when(F.col("plausible"), 1)).alias("n_plausible"))


def cosine_topk(spark, sf):
    """For every vector whose id is divisible by 100 the five nearest others of its label, by cosine."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label", F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = asked.join(rows, "label").where("vec_id <> query")
    near = met.select("query", "vec_id", F.round(dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v"))), 6).alias("cosine"))
    return rank_within(near, ["query"], [F.desc("cosine"), F.col("vec_id")]).where("rank <= 5").select("query", "rank", "vec_id", "cosine")  # kept before the shuffle


def _phrases(spark, sf):
    """``alias, code``: the first three words of each benchmark item."""
    items = matching.prepared(table(spark, sf, "benchmark"), "item_id")
    return items.select(F.array_join(F.slice("words", 1, 3), " ").alias("alias"), F.concat(F.lit("B_"), "id").alias("code")).where("alias <> ''")


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def alias_spans(spark, sf):
    """Where documents say the beginning of a benchmark item, with how well."""
    return matching.strongest(matching.spans(_texts(spark, sf), _phrases(spark, sf))).select("id", "code", "place", "size", "coverage", "precision", "score")


def near_misses(spark, sf):
    """What to ask back: beginnings of benchmark items that a document nearly has."""
    asks = _phrases(spark, sf).groupBy("code").agg(F.concat(F.lit("Did you mean "), F.min("alias"), F.lit("?")).alias("question"))
    return questions.near_misses(matching.spans(_texts(spark, sf), _phrases(spark, sf)), asks)


def keyword_ranking(spark, sf):
    """Product names that read like each document."""
    bias = {"bolt": ("blue bolt", "small bolt"), "ring": ("small ring",)}
    return matching.keyword_ranking(_texts(spark, sf), roles.aliases(spark, sf).select(F.col("alias").alias("label")), bias)


def pain_values(spark, sf):
    """Intensity, onset and precision of place, each in a wording of its own."""
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 11).cast("string").alias("n"))
    kind = F.col("p_partkey") % 5
    said = F.when(kind == 0, F.concat(F.lit("The pain intensity is "), "n")).when(kind == 1, F.concat(F.lit("My pain started at "), "n")).when(kind == 2, F.concat(F.lit("pain location is "), "n")).when(kind == 3, F.concat(F.lit("The pain is "), "n", F.lit(" out of 10"))).otherwise(F.concat(F.lit("The level is "), "n"))
    return parts.select("p_partkey", *[text.pain_value(said, w).alias(w) for w in text.PAIN_VALUES])


def report_measurements(spark, sf):
    """Reports of the lines of each order: a colon layout, a wide one, a name with its value on the next line, and a pressure."""
    q = F.col("q").cast("int")
    kinds = ("Glucose", "Total Cholesterol", "Creatinine", "Platelets", "BP", "HbA1c", "Sodium")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    numbered = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    lines = numbered.select("l_orderkey", "l_linenumber", kind.alias("kind"), (F.col("l_linenumber") % 3).alias("how"), q.cast("string").alias("q"), (q + 100).cast("string").alias("top"), (q + 40).cast("string").alias("low"))
    one = F.when(F.col("kind") == "BP", F.array(F.concat(F.lit("BP: "), "top", F.lit("/"), "low"))).when(F.col("how") == 0, F.array(F.concat("kind", F.lit(": "), "q", F.lit(" mg/dL")))).when(F.col("how") == 1, F.array(F.concat(F.lit("| "), "kind", F.lit(" | "), "q"))).otherwise(F.array(F.col("kind"), F.concat("q", F.lit(" mg/dL"))))
    rows = lines.select(F.col("l_orderkey").alias("doc"), "l_linenumber", F.posexplode(one).alias("i", "line"))
    names = spark.createDataFrame([(k, k.lower()) for k in kinds if k != "BP"], "alias string, kind string")
    return lab_lines.report_items(rows.select("doc", (F.col("l_linenumber") * 2 + F.col("i")).alias("no"), "line"), names).select("doc", "kind", "value", "unit", "confidence")


def conv_state_last_polarity(spark, sf):
    found = matching.contained_in_wordings(roles.reports(spark, sf), roles.aliases(spark, sf)).withColumn("conv", F.floor(F.col("id") / 10)).withColumn("turn", F.col("id") % 10)
    return matching.last_polarity(found)


def polarity_conflicts(spark, sf):
    """Codes that the reports of an order both affirm and deny."""
    found = matching.contained_in_wordings(roles.reports(spark, sf), roles.aliases(spark, sf)).withColumn("conv", F.floor(F.col("id") / 10))
    return matching.conflicting(found, "conv")


def _normal(column: str) -> str:
    """Normal form in SQL: full stops that end a number's first part are protected while the others go; words are replaced whole."""
    plain = f"replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({column}), '’', chr(39)), '[^a-z0-9.'']+', ' ', 'g'), '\\.([0-9])', '§\\1', 'g'), '\\.', ' ', 'g'), '§', '.')"
    out = f"' ' || replace({plain}, ' ', '  ') || ' '"
    for short, long in text.CONTRACTIONS:
        quoted = short.replace("'", "''")
        out = f"replace({out}, ' {quoted} ', ' {long} ')"
    return f"trim(regexp_replace({out}, '[ '']+', ' ', 'g'))"


_REP = f"WITH {SQL['reports']}, {SQL['aliases']}, n AS (SELECT id, {_normal('text')} AS normal FROM reports), w AS (SELECT id, list_filter(string_split(normal, ' '), lambda x: x <> '') AS words FROM n)"
_HITS = """h AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS place FROM w),
    c AS (SELECT id, code, words, place, 2 AS n_alias FROM h JOIN aliases ON alias = words[place] || ' ' || words[place + 1])"""
_LISTED = lambda ws: "[" + ", ".join(repr(w) for w in ws) + "]"
_POS = lambda ws, xs: f"coalesce(list_max(list_filter(range(1, len({xs}) + 1), lambda i: list_contains({_LISTED(ws)}, {xs}[i]))), 0)"
_NEG = f"""a AS (SELECT id, code, place, words[greatest(1, place - 6):place - 1] AS ahead, words[place + 2:place + 5] AS behind FROM c),
    b AS (SELECT id, code, place, {_POS(text.CUES_BEFORE, 'ahead')} > {_POS(text.CLAUSE_ENDS, 'ahead')} AS early, behind, coalesce(list_min(list_filter(range(1, len(behind) + 1), lambda i: behind[i] IN {text.CLAUSE_ENDS})), 5) AS stop FROM a),
    g AS (SELECT id, code, place, early OR len(list_filter(range(1, len(behind) + 1), lambda i: i < stop AND behind[i] IN {text.CUES_AFTER})) > 0 OR contains(' ' || array_to_string(behind, ' ') || ' ', ' ruled out ') AS negated FROM b)"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP)
_LINES = """ln AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_linenumber - 1) % 7 + 1 AS k, CAST(l_quantity AS INT) AS q FROM lineitem),
    one AS (SELECT id, k, lower(['Glucose', 'Cholesterol', 'Creatinine', 'Platelets', '', 'HbA1c', 'Leukocytes'][k]) AS kind, CASE WHEN k = 7 THEN q * 5.0 ELSE CAST(q || '.' || (q % 10) AS DOUBLE) END AS value, ['mmol/L', 'mmol/L', 'umol/L', 'lakhs/cumm', 'mmHg', 'mmol/mol', '/cumm'][k] AS unit FROM ln WHERE k <> 5
        UNION ALL SELECT id, k, 'systolic', q + 100, 'mmHg' FROM ln WHERE k = 5 UNION ALL SELECT id, k, 'diastolic', q + 40, 'mmHg' FROM ln WHERE k = 5),
    cv AS (SELECT id, kind, CASE kind WHEN 'glucose' THEN round(value * 18.0182::DOUBLE + 3.7e-8, 1) WHEN 'cholesterol' THEN round(value * 38.67::DOUBLE + 3.7e-8, 1) WHEN 'creatinine' THEN round(value * 0.0113::DOUBLE + 3.7e-8, 2) WHEN 'platelets' THEN round(value * 100 + 3.7e-8, 1)
        WHEN 'leukocytes' THEN CASE WHEN value > 100 THEN round(value / 1000 + 3.7e-8, 2) ELSE value END WHEN 'hba1c' THEN round(value * 0.09148::DOUBLE + 2.152::DOUBLE + 3.7e-8, 2) ELSE value END AS value, CASE kind WHEN 'glucose' THEN 'mg/dL' WHEN 'cholesterol' THEN 'mg/dL' WHEN 'creatinine' THEN 'mg/dL' WHEN 'platelets' THEN '10³/µL' WHEN 'leukocytes' THEN '10³/µL' WHEN 'hba1c' THEN '%' ELSE unit END AS unit FROM one)"""

def pain_locations(spark, sf):
    """The place that each order line's sentence names; nouns of product names stand for parts of the body with two sides."""
    parts = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ")[1].alias("noun"))
    nouns = parts.select("noun").distinct()
    sided = nouns.select(F.explode(F.array(*[F.struct(F.concat("noun", F.lit(s)).alias("meaning"), F.lit(i).alias("ordinal")) for i, s in enumerate(("(R)", " (L)"))])).alias("x")).select("x.*")
    catalogue = sided.unionByName(spark.sql("SELECT * FROM VALUES ('upper chest', 5), ('knee (R)', 6), ('biceps(L)', 7) AS t(meaning, ordinal)"))
    kind, noun = F.col("l_linenumber") % 7, F.col("noun")
    said = (
        F.when(kind == 0, F.concat(F.lit("My "), noun, F.lit(" hurts!")))
        .when(kind == 1, F.concat(F.lit("There is pain in the left "), noun))
        .when(kind == 2, F.concat(F.lit("Right "), F.upper(noun), F.lit(", an ache since monday")))
        .when(kind == 3, F.concat(F.lit("The left "), noun, F.lit(" is fine")))
        .when(kind == 4, F.lit("chest pain"))
        .when(kind == 5, F.concat(F.lit("A painful left biceps muscle and "), noun))
        .otherwise(F.lit("aching joints, the painfully large ones"))
    )
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    met = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    texts = met.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), said.alias("text"))
    return locations.pain_locations(texts, locations.location_aliases(catalogue.withColumn("value", F.col("meaning"))))


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, alias_exact, alias_containment, alias_overlap, alias_fuzzy, alias_longest, negation_scope, polarity_counts, value_intensity, lab_lines_parsed, unit_convert, plausibility, cosine_topk, conv_state_last_polarity,
        alias_spans, near_misses, keyword_ranking, pain_values, pain_locations, polarity_conflicts, report_measurements,
    )
}
ORACLES = {
    "text_normalize": f"WITH n AS (SELECT conv_id * 1000 + turn AS id, {_normal('text')} AS normal FROM conversations) SELECT id, md5(normal) AS normal_md5, len(list_filter(string_split(normal, ' '), lambda x: x <> '')) AS n_words FROM n",
    "alias_exact": f"WITH {SQL['aliases']} SELECT p_partkey AS id, code FROM part JOIN aliases ON alias = p_name",
    "alias_containment": f"{_REP}, {_HITS} SELECT id, code, count(*) AS n, min(place) AS place FROM c GROUP BY 1, 2",
    "alias_overlap": f"""WITH {SQL['reports']}, {SQL['aliases']}, u AS (SELECT text, min(id) AS id FROM reports GROUP BY text), n AS (SELECT id, list_distinct(list_filter(string_split({_normal('text')}, ' '), lambda x: x NOT IN ({_STOP}) AND length(x) > 1)) AS ws FROM u),
        t AS (SELECT id, len(ws) AS nt, unnest(ws) AS word FROM n), k AS (SELECT code, unnest(string_split(alias, ' ')) AS word FROM aliases), m AS (SELECT id, code, count(*) AS shared, any_value(nt) AS nt FROM t JOIN k USING (word) GROUP BY 1, 2)
        SELECT id, code, shared, round(shared / 2, 6) AS coverage, round(shared / nt, 6) AS precision, round(0.6::DOUBLE * (shared / 2) + 0.4::DOUBLE * (shared / nt), 6) AS score FROM m""",
    "alias_longest": f"WITH {SQL['aliases']} SELECT p_partkey AS id, code, 2 AS place, 2 AS n_alias FROM part JOIN aliases ON alias = p_name",
    "negation_scope": f"{_REP}, {_HITS}, {_NEG} SELECT id, code, max(negated) AS negated FROM g GROUP BY 1, 2",
    "polarity_counts": f"{_REP}, {_HITS}, {_NEG} SELECT code, count(*) AS n, count(*) FILTER (negated) AS n_negated FROM g GROUP BY code",
    "value_intensity": f"WITH {SQL['reports']} SELECT id, CAST(regexp_extract(lower(text), '\\b(10|[0-9])\\s*(?:/|out of)\\s*10\\b', 1) AS INT) AS intensity FROM reports WHERE regexp_matches(lower(text), '\\b(10|[0-9])\\s*(?:/|out of)\\s*10\\b')",
    "lab_lines_parsed": f"WITH {_LINES} SELECT id, kind, value, unit FROM one",
    "unit_convert": f"WITH {_LINES} SELECT id, kind, value, unit FROM cv",
    "plausibility": f"""WITH {_LINES}, b AS (SELECT * FROM (VALUES ('glucose', 10, 1000), ('cholesterol', 20, 1000), ('creatinine', 0.05, 30), ('platelets', 1, 2000), ('systolic', 40, 300), ('diastolic', 20, 200)) v(kind, low, high))
        SELECT kind, unit, count(*) AS n, count(*) FILTER (value BETWEEN coalesce(low, 0) AND coalesce(high, 10000)) AS n_plausible FROM cv LEFT JOIN b USING (kind) GROUP BY 1, 2""",
    "cosine_topk": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM m) SELECT query, rank, vec_id, cosine FROM r WHERE rank <= 5""",
    "polarity_conflicts": f"{_REP}, {_HITS}, {_NEG} SELECT id // 10 AS conv, code, count(*) FILTER (NOT negated) AS affirmed, count(*) FILTER (negated) AS denied FROM g GROUP BY 1, 2 HAVING bool_or(negated) AND NOT bool_and(negated)",
    "pain_locations": """WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 7 AS k, split_part(p_name, ' ', 2) AS noun FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey)
        SELECT id, CASE k WHEN 0 THEN noun || '(R)' WHEN 1 THEN noun || ' (L)' WHEN 2 THEN noun || '(R)' WHEN 4 THEN 'upper chest' WHEN 5 THEN 'biceps(L)' ELSE 'knee (R)' END AS value,
            CASE k WHEN 0 THEN noun WHEN 1 THEN 'left ' || noun WHEN 2 THEN 'right ' || noun WHEN 4 THEN 'chest pain' WHEN 5 THEN 'left biceps muscle' ELSE 'aching joints' END AS matched FROM n WHERE k <> 3""",
    "pain_values": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 3) THEN CAST(p_size % 11 AS INT) END AS intensity, CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size % 11 AS INT) END AS onset, CASE WHEN p_partkey % 5 = 2 THEN CAST(p_size % 11 AS INT) END AS precision FROM part",
    "report_measurements": """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, (l_linenumber - 1) % 7 + 1 AS k, l_linenumber % 3 AS how, CAST(min(l_quantity) AS INT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY n, how) AS i FROM l), o AS (SELECT * FROM f WHERE i = 1 AND k <> 5)
        SELECT doc, lower(['Glucose', 'Total Cholesterol', 'Creatinine', 'Platelets', '', 'HbA1c', 'Sodium'][k]) AS kind, CASE WHEN k = 6 AND q > 25 THEN round(q * 0.09148::DOUBLE + 2.152::DOUBLE + 3.7e-8, 2) ELSE q END::DOUBLE AS value,
            CASE WHEN k IN (1, 2, 3) THEN 'mg/dL' WHEN k = 4 THEN '10³/µL' WHEN k = 6 THEN '%' WHEN how = 1 THEN '' ELSE 'mg/dL' END AS unit, CASE WHEN how = 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM o
        UNION ALL SELECT doc, 'systolic', q + 100, 'mmHg', 0.95 FROM f WHERE i = 1 AND k = 5 UNION ALL SELECT doc, 'diastolic', q + 40, 'mmHg', 0.95 FROM f WHERE i = 1 AND k = 5""",
    "conv_state_last_polarity": f"{_REP}, {_HITS}, {_NEG} SELECT id // 10 AS conv, code, NOT arg_max(negated, {{'t': id % 10, 'n': negated}}) AS positive, max(id % 10) AS turn FROM g GROUP BY 1, 2",
}
