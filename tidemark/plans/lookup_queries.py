"""Queries of lookups that fall back, and of the sections that a read view is put together from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lab_lines, lookups, serving
from tidemark.operators.evaluation import rank_within
from tidemark.operators.ranking import hash_order, hash_ranked
from tidemark.sources.readers import table
from tidemark.streaming import caches


def subsample_hash(spark, sf):
    """A subsample of 1,000 orders by hash (what this operator is for)."""
    keyed = table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("_h", hash_order(F.col("o_orderkey")))
    return hash_ranked(keyed, "_h").where("rank <= 1000").select("o_orderkey", "o_custkey")


def name_tiers(spark, sf):
    parts = table(spark, sf, "part")
    # names from the middle of the alphabet on are canonical under another spelling, so those asked for are missed
    canonical = F.when(F.col("p_name") < "m", F.col("p_name")).otherwise(F.concat(F.lit("x"), F.md5("p_name")))
    canon = parts.groupBy(canonical.alias("canonical")).agg(F.min("p_partkey").alias("ordinal"))
    kind = F.col("p_partkey") % 5
    name = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.upper("p_name")).when(kind == 2, F.replace("p_name", F.lit(" "), F.lit("-"))).when(kind == 3, F.concat(F.lit("fine "), "p_name", F.lit(" set"))).otherwise(F.concat(F.lit("odd "), F.element_at(F.split("p_name", " "), 2)))
    return lookups.tiered(parts.select(name.alias("name")), canon)


def lookup_fanout(spark, sf):
    """The three commonest product names of each customer, looked up once each."""
    orders, lines = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    counted = bought.groupBy("o_custkey", "p_name").agg(F.count("*").alias("n"))
    top = rank_within(counted, ["o_custkey"], [F.desc("n"), F.col("p_name")]).where("rank <= 3").select(F.concat(F.lit(" "), F.upper("p_name")).alias("name"))
    size = parts.groupBy(F.col("p_name").alias("key")).agg(F.min("p_size").alias("m"))
    entry = F.when(F.col("key") > "c", F.col("key")).otherwise(F.concat(F.lit("old "), "key"))  # entries under a name that is no longer asked for
    return lookups.cached(top, size.select(entry.alias("key"), F.when(F.col("m") > 1, "FOUND").otherwise("NONE").alias("status"), F.col("m").alias("detail")))


def report_dates(spark, sf):
    orders = table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 6
    d = F.col("o_orderdate")
    said = (
        F.when(kind == 0, F.concat(F.lit("Printed 2001-02-03. Report date: "), F.date_format(d, "yyyy/M/d")))
        .when(kind == 1, F.concat(F.lit("Collected "), F.date_format(d, "d/M/yyyy"), F.lit(" at noon")))
        .when(kind == 2, F.concat(F.lit("date: "), F.date_format(d, "MMMM d, yyyy")))
        .when(kind == 3, F.concat(F.lit("seen "), F.date_format(d, "d-M-yyyy")))
        .when(kind == 4, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd")))
        .otherwise(F.lit("no day, born 01/02/1907"))
    )
    text = F.concat(said, F.lit("."))
    return orders.select("o_orderkey", lookups.first_date(text).alias("day"))


def combine_atoms(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("E"), (F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("_@_"), (F.col("l_linenumber") % 2).cast("string"))).otherwise("")).alias("a"))
    bags = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("a")).alias("atoms"))
    return bags.select("l_orderkey", F.concat_ws(",", lookups.combined_atoms(F.col("atoms"))).alias("atoms"))


def latest_biomarkers(spark, sf):
    """The latest value of each return flag over each customer's last three orders, at most 15."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    last = serving.recent(orders, "o_custkey", "o_orderdate", "o_orderkey", 3).drop("rank")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    met = last.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    newest = met.groupBy("o_custkey", F.col("l_returnflag").alias("kind")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "l_extendedprice")).alias("m"))
    return rank_within(newest, ["o_custkey"], [F.col("kind")]).where("rank <= 15").select("o_custkey", "kind", F.col("m.l_extendedprice").alias("value"), F.col("m.o_orderdate").alias("ts"))


def suggested_prompts(spark, sf):
    c = table(spark, sf, "customer")
    rules = [(F.col("c_acctbal") < 0, "Why is my balance low?"), (F.col("c_mktsegment") == "BUILDING", "What is new in building?"), (F.col("c_nationkey") < 10, "What ships near me?"), (F.lit(True), "Show my history"), (F.lit(True), "Show my history"), (F.col("c_acctbal") > 5000, "What can I afford?"), (F.lit(True), "Help")]
    return c.select("c_custkey", F.concat_ws("|", lookups.prompts(rules)).alias("prompts"))


def action_categories(spark, sf):
    kinds = {"metal": r"(^|[^a-z])(bolt|gear|anvil)", "round": "ring|wheel", "tool": "widget"}
    return table(spark, sf, "part").select("p_partkey", lookups.category(F.col("p_name"), kinds, "other").alias("category"))


def rule_protocols(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), "p_size", "p_retailprice", "p_type")
    return lookups.protocols(rows, [("large", F.col("p_size") >= 40, 0.88), ("dear", F.col("p_retailprice") > 1000, 0.82), ("promo", F.col("p_type") == "PROMO", 0.78)])


def populate_twice(spark, sf):
    """Suppliers and customers of the same nation: both sides' names by two left joins of the same table."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    s, c = nation.alias("s"), nation.alias("c")
    pairs = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", (F.col("o_orderkey") % 30).cast("int").alias("other"))
    joined = pairs.join(c, F.col("c_nationkey") == F.col("c.n_nationkey"), "left").join(s, F.col("other") == F.col("s.n_nationkey"), "left")
    return joined.select("o_orderkey", F.col("c.n_name").alias("own"), F.col("s.n_name").alias("other"))


def text_report(spark, sf):
    """A report of lines for each customer."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return o.select("o_custkey", F.concat_ws("\n", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.concat(F.lit("Orders: "), F.col("n").cast("string")), F.concat(F.lit("Last: "), F.date_format("last", "yyyy-MM-dd"))).alias("report"))


def nested_view(spark, sf):
    """One document for each customer: its last three orders, its five dearest lines, and its latest two days of each kind of order."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sections = {
        "orders": (orders.select("o_custkey", F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("class"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), [F.desc("day"), F.desc("key")], 3),
        "lines": (lines.select("o_custkey", F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.floor("l_extendedprice").alias("price")), [F.desc("price"), F.col("key"), F.col("line"), F.col("part")], 5),
        "open": (orders.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("key")), [F.col("key")], 2),
    }
    found = serving.documents(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", sections)
    return found.select("o_custkey", "c_name", *[F.to_json(name).alias(name) for name in sections])


def measurement_names(spark, sf):
    """What eight ways of writing a measurement's name mean; product names stand for the dictionary's aliases."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    kind, name, two = F.col("p_partkey") % 8, F.col("p_name"), F.split("p_name", " ")
    key = F.col("p_partkey").cast("string")
    said = (
        F.when(kind == 0, F.concat(F.lit("  "), F.upper(name), F.lit("!")))
        .when(kind == 1, F.concat(F.lit("("), two[0], F.lit(") "), two[1]))
        .when(kind == 2, F.concat(F.lit("TSH - "), name))
        .when(kind == 3, F.concat(name, F.lit(" potassium ratio")))
        .when(kind == 4, F.concat(F.lit("Serum Potassium "), key))
        .when(kind == 5, F.concat(F.lit("level of "), two[1], F.lit(" "), two[0]))
        .when(kind == 6, F.concat(name, F.lit("s in urine")))
        .otherwise(F.concat(F.lit("tshx "), key))
    )
    dictionary = parts.groupBy("p_name").agg(F.min("p_partkey").alias("ordinal")).select(F.col("p_name").alias("alias"), F.concat(F.lit("of "), "p_name").alias("target"), (F.col("p_name") < "m").alias("canonical"), "ordinal")
    return lookups.measurement_names(parts.select(said.alias("name")), dictionary)


def condition_profiles(spark, sf):
    """Profiles of conditions asked for by name, in capitals, within other words, by a part of the name, and by none that is known."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    kind, name = F.col("p_partkey") % 6, F.col("p_name")
    asked = F.when(kind == 0, F.initcap(name)).when(kind == 1, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).when(kind == 2, F.concat(F.lit("Chronic "), name)).when(kind == 3, F.substring(name, 3, 6)).when(kind == 4, F.concat(F.lit("Z"), F.col("p_partkey").cast("string")))
    known = parts.where("p_name < 'p'").groupBy("p_name").agg(F.min("p_partkey").alias("ordinal"), F.min("p_type").alias("category"), F.max("p_size").alias("size"))
    dictionary = known.select(F.initcap("p_name").alias("profile"), "ordinal", "category", F.concat(F.lit("size "), F.col("size").cast("string")).alias("description"), (F.col("size") > 45).alias("emergency"))
    return lookups.condition_profiles(parts.select(asked.alias("name")), dictionary)


def unit_defaults(spark, sf):
    """Values of order lines under five kinds; those without a rule of conversion take the unit that the dictionary has."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    kind = F.element_at(F.array(*map(F.lit, ("sodium", "glucose", "ferritin", "unlisted", "creatinine"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    unit = F.when(F.col("l_orderkey") % 3 == 0, "mmol/L").when(F.col("l_orderkey") % 3 == 1, "")
    units = spark.sql("SELECT * FROM VALUES ('sodium', 'mEq/L'), ('ferritin', 'ng/mL'), ('creatinine', 'no unit') AS t(kind, unit)")
    items = lines.select("l_orderkey", "l_linenumber", kind.alias("kind"), F.floor("l_quantity").cast("double").alias("value"), unit.alias("unit"))
    done = lab_lines.converted(items, units)
    return done.groupBy("kind", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("total"))


def cache_expiry(spark, sf):
    """Views of users as lookups of what sign-ups (found), purchases (nothing found) and errors (failures) say, for a day each."""
    events = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "signup", "FOUND").when(F.col("event_type") == "purchase", "NONE").otherwise("FAILED")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    answers = events.where("event_type in ('signup', 'purchase', 'error')").select(key.alias("key"), "ts", status.alias("status"), F.col("event_id").cast("string").alias("detail"))
    asks = events.where("event_type = 'view'").select(F.col("event_id").alias("ask_id"), key.alias("key"), "ts")
    return caches.looked_up(asks, answers, 86_400)


QUERIES = {f.__name__: f for f in (measurement_names, condition_profiles, unit_defaults, cache_expiry, nested_view, subsample_hash, name_tiers, lookup_fanout, report_dates, combine_atoms, latest_biomarkers, suggested_prompts, action_categories, rule_protocols, populate_twice, text_report)}
#: What the cache of answers says to lookups, and at which times.
CACHE_SQL = """WITH a AS (SELECT 'u' || user_id AS key, ts, CASE event_type WHEN 'signup' THEN 'FOUND' ELSE 'NONE' END AS status, CAST(event_id AS VARCHAR) AS detail FROM events WHERE event_type IN ('signup', 'purchase')),
        q AS (SELECT event_id AS ask_id, 'u' || user_id AS key, ts FROM events WHERE event_type = 'view'),
        m AS (SELECT ask_id, q.key, q.ts, a.status, a.detail, epoch_us(q.ts) - epoch_us(a.ts) AS old, row_number() OVER (PARTITION BY ask_id ORDER BY a.ts DESC, a.status DESC, a.detail DESC) AS i FROM q LEFT JOIN a ON a.key = q.key AND a.ts <= q.ts AND a.ts > q.ts - INTERVAL 1 DAY)
        SELECT ask_id, key, ts, coalesce(status, 'MISS') AS status, detail, old / 1e6 AS age FROM m WHERE i = 1"""
ORACLES = {
    "cache_expiry": CACHE_SQL,
    "measurement_names": """WITH n AS (SELECT p_partkey AS id, p_partkey % 8 AS k, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
        s AS (SELECT *, CASE k WHEN 0 THEN '  ' || upper(p_name) || '!' WHEN 1 THEN '(' || a || ') ' || b WHEN 2 THEN 'TSH - ' || p_name WHEN 3 THEN p_name || ' potassium ratio' WHEN 4 THEN 'Serum Potassium ' || id WHEN 5 THEN 'level of ' || b || ' ' || a WHEN 6 THEN p_name || 's in urine' ELSE 'tshx ' || id END AS name FROM n)
        SELECT DISTINCT name, CASE k WHEN 2 THEN 'Thyroid Stimulating Hormone' WHEN 4 THEN 'Potassium' WHEN 7 THEN NULL ELSE 'of ' || p_name END AS target, CASE k WHEN 2 THEN false WHEN 4 THEN true WHEN 7 THEN NULL ELSE p_name < 'm' END AS canonical,
            ['exact', 'bare', 'acronym', 'contained', 'keyword', 'overlap', 'contained', NULL][k + 1] AS tier, [1.0, 0.98, 0.95, 0.92, 0.90, 0.85, 0.92, NULL][k + 1]::DOUBLE AS confidence FROM s""",
    "condition_profiles": """WITH c AS (SELECT *, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS cap FROM part),
        p AS (SELECT min(cap) AS profile, min(p_partkey) AS ordinal, min(p_type) AS category, max(p_size) AS size FROM c WHERE p_name < 'p' GROUP BY p_name),
        q AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN cap WHEN 1 THEN ' ' || upper(p_name) || ' ' WHEN 2 THEN 'Chronic ' || p_name WHEN 3 THEN substr(p_name, 3, 6) WHEN 4 THEN 'Z' || p_partkey ELSE 'Clinical Condition' END AS name FROM c),
        m AS (SELECT name, p.*, CASE WHEN name = profile THEN 0 WHEN lower(trim(name)) = lower(profile) THEN 1 ELSE 2 END AS tier FROM q JOIN p ON contains(lower(trim(name)), lower(profile)) OR contains(lower(profile), lower(trim(name)))),
        b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, ordinal) AS i FROM m)
        SELECT q.name, coalesce(profile, q.name) AS profile, coalesce(['exact', 'folded', 'contained'][tier + 1], 'general') AS tier, coalesce(category, 'General Clinical') AS category, coalesce('size ' || size, 'Targeted clinical management and therapeutic protocol for ' || q.name || '.') AS description, coalesce(size > 45, false) AS emergency FROM q LEFT JOIN b ON b.name = q.name AND i = 1""",
    "unit_defaults": """WITH l AS (SELECT ['sodium', 'glucose', 'ferritin', 'unlisted', 'creatinine'][l_linenumber % 5 + 1] AS kind, floor(l_quantity)::DECIMAL(18, 6) AS v, CASE l_orderkey % 3 WHEN 0 THEN 'mmol/L' WHEN 1 THEN '' END AS u FROM lineitem)
        SELECT kind, CASE kind WHEN 'sodium' THEN 'mEq/L' WHEN 'ferritin' THEN 'ng/mL' WHEN 'unlisted' THEN u ELSE 'mg/dL' END AS unit, count(*) AS n, round(sum(CASE WHEN kind = 'glucose' AND u = 'mmol/L' THEN round(v * 18.0182, 1) ELSE v END), 1)::DOUBLE AS total FROM l GROUP BY 1, 2""",
    "nested_view": """WITH o AS (SELECT o_custkey, o_orderkey AS key, o_orderpriority AS class, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC) AS i FROM orders),
        l AS (SELECT o_custkey, l_orderkey AS key, l_linenumber AS line, l_partkey AS part, floor(l_extendedprice)::BIGINT AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(l_extendedprice) DESC, l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        p AS (SELECT o_custkey, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O'),
        a AS (SELECT o_custkey, to_json(list({'key': key, 'class': class, 'day': day} ORDER BY i))::VARCHAR AS orders FROM o WHERE i <= 3 GROUP BY 1), b AS (SELECT o_custkey, to_json(list({'key': key, 'line': line, 'part': part, 'price': price} ORDER BY i))::VARCHAR AS lines FROM l WHERE i <= 5 GROUP BY 1),
        c AS (SELECT o_custkey, to_json(list({'key': key} ORDER BY i))::VARCHAR AS open FROM p WHERE i <= 2 GROUP BY 1)
        SELECT c_custkey AS o_custkey, c_name, coalesce(orders, '[]') AS orders, coalesce(lines, '[]') AS lines, coalesce(open, '[]') AS open FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""",
    "subsample_hash": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '|42') LIMIT 1000",
    "name_tiers": """WITH canon AS (SELECT p_name AS canonical, min(p_partkey) AS ordinal FROM part WHERE p_name < 'm' GROUP BY 1),  -- the others' spellings share no word with what is asked
        nm AS (SELECT DISTINCT p_name AS p, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN 'fine ' || p_name || ' set' ELSE 'odd ' || split_part(p_name, ' ', 2) END AS name FROM part),
        w AS (SELECT DISTINCT name, list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 1) AS ws FROM nm), c AS (SELECT *, string_split(canonical, ' ') AS cw FROM canon),
        m AS (SELECT name, canonical, ordinal, CASE WHEN name = canonical THEN 'exact' WHEN lower(name) = canonical THEN 'folded' WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = replace(canonical, ' ', '') THEN 'squeezed' WHEN contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || canonical || ' ') THEN 'contained' ELSE 'overlap' END AS tier,
            len(list_intersect(ws, cw)) / least(len(list_distinct(ws)), len(list_distinct(cw))) AS share FROM w JOIN c ON len(list_intersect(ws, cw)) > 0 AND len(list_intersect(ws, cw)) / least(len(list_distinct(ws)), len(list_distinct(cw))) >= 0.5),
        s AS (SELECT *, CASE tier WHEN 'exact' THEN 1.0 WHEN 'folded' THEN 0.98 WHEN 'squeezed' THEN 0.95 WHEN 'contained' THEN 0.92 ELSE round(0.85 * share, 6) END::DOUBLE AS confidence FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, ordinal, canonical DESC) AS i FROM s)
        SELECT w.name, canonical, tier, confidence FROM w LEFT JOIN (SELECT * FROM b WHERE i = 1) b ON b.name = w.name""",
    "lookup_fanout": """WITH n AS (SELECT o_custkey, p_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_name) AS i FROM n),
        c AS (SELECT p_name AS key, min(p_size) AS m FROM part GROUP BY 1 HAVING p_name > 'c') SELECT DISTINCT p_name AS name, CASE WHEN m IS NULL THEN 'MISS' WHEN m > 1 THEN 'FOUND' ELSE 'NONE' END AS status, m AS detail FROM k LEFT JOIN c ON key = p_name WHERE i <= 3""",
    "report_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "combine_atoms": """WITH a AS (SELECT DISTINCT l_orderkey, 'E' || (l_partkey % 7) AS code, CASE WHEN l_suppkey % 3 = 0 THEN '_@_' || (l_linenumber % 2) ELSE '' END AS v FROM lineitem)
        SELECT l_orderkey, array_to_string(list_sort(list(code || v)), ',') AS atoms FROM a WHERE v <> '' OR NOT EXISTS (SELECT 1 FROM a b WHERE b.l_orderkey = a.l_orderkey AND b.code = a.code AND b.v <> '') GROUP BY l_orderkey""",
    "latest_biomarkers": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders), m AS (SELECT o_custkey, l_returnflag AS kind, l_extendedprice AS value, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey, l_returnflag ORDER BY o_orderdate DESC, o_orderkey DESC, l_extendedprice DESC) AS j FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE i <= 3)
        SELECT o_custkey, kind, value, ts FROM m WHERE j = 1""",
    "suggested_prompts": """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'Why is my balance low?' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'What is new in building?' END, CASE WHEN c_nationkey < 10 THEN 'What ships near me?' END, 'Show my history', CASE WHEN c_acctbal > 5000 THEN 'What can I afford?' END, 'Help'], lambda x: x IS NOT NULL)[1:4], '|') AS prompts FROM customer""",
    "action_categories": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(^|[^a-z])(bolt|gear|anvil)') THEN 'metal' WHEN regexp_matches(p_name, 'ring|wheel') THEN 'round' WHEN contains(p_name, 'widget') THEN 'tool' ELSE 'other' END AS category FROM part",
    "rule_protocols": "SELECT p_partkey AS entity, 'large' AS name, 0.88::DOUBLE AS score FROM part WHERE p_size >= 40 UNION ALL SELECT p_partkey, 'dear', 0.82 FROM part WHERE p_retailprice > 1000 UNION ALL SELECT p_partkey, 'promo', 0.78 FROM part WHERE p_type = 'PROMO'",
    "populate_twice": "SELECT o_orderkey, c.n_name AS own, s.n_name AS other FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation c ON c.n_nationkey = c_nationkey LEFT JOIN nation s ON s.n_nationkey = o_orderkey % 30",
    "text_report": "SELECT o_custkey, 'Customer ' || o_custkey || chr(10) || 'Orders: ' || count(*) || chr(10) || 'Last: ' || strftime(max(o_orderdate), '%Y-%m-%d') AS report FROM orders GROUP BY o_custkey",
}
