"""Lookups that fall back: names by tiers, cached facts, dates in several formats, atoms that make others redundant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import content_tokens, normalised, overlap, tokens
from tidemark.session import stored

#: Where a report's date may stand, in the order of trust, and formats of numbers and with names of months.
_LABELS = r"(?:report\s*date|collected|collection\s*date|date\s*of\s*collection|specimen\s*date|test\s*date|sample\s*date|registered\s*on|registration\s*date)"
DATE_PLACES = (
    rf"(?i){_LABELS}[:\s]+(\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}})",
    rf"(?i){_LABELS}[:\s]+(\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}})",
    r"(?i)(?:report\s*date|collected|date)[:\s]+([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})",
    r"(\d{4}-\d{2}-\d{2})",
    r"(\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{1,2}-\d{1,2}-\d{4})",
)
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMM yyyy", "d MMMM yyyy")
#: Confidence of each tier of a name's match; the last one is multiplied by the overlap of words.
TIERS = {"exact": 1.0, "folded": 0.98, "squeezed": 0.95, "contained": 0.92, "within": 0.90, "overlap": 0.85}

#: Short names of measurements that tell them wherever they stand as a word, in the order in which they are
#: tried, and whether the measurement is one of the canonical ones.
ACRONYMS = (
    ("tsh", "Thyroid Stimulating Hormone", False),
    ("ft3", "Free Triiodothyronine", False),
    ("ft4", "Free Thyroxine", False),
    ("t3", "Triiodothyronine", False),
    ("t4", "Thyroxine", False),
    ("bun", "Urea Nitrogen", True),
    ("fbs", "Glucose", True),
    ("ppbs", "Glucose", True),
    ("rbs", "Glucose", True),
    ("fpg", "Glucose", True),
    ("alt", "Alanine aminotransferase [Enzymatic activity/volume] in Serum or Plasma", True),
    ("ast", "Aspartate aminotransferase [Enzymatic activity/volume] in Serum or Plasma", True),
    ("alp", "Alkaline phosphatase [Enzymatic activity/volume] in Serum or Plasma", True),
    ("sgpt", "Alanine aminotransferase [Enzymatic activity/volume] in Serum or Plasma", True),
    ("sgot", "Aspartate aminotransferase [Enzymatic activity/volume] in Serum or Plasma", True),
    ("ggt", "Gamma Glutamyl Transferase", False),
    ("ggtp", "Gamma Glutamyl Transferase", False),
    ("wbc", "Leukocytes [#/volume] in Blood by Automated count", True),
    ("tlc", "Leukocytes [#/volume] in Blood by Automated count", True),
    ("plt", "Platelets [#/volume] in Blood by Automated count", True),
    ("tpc", "Platelets [#/volume] in Blood by Automated count", True),
    ("pcv", "Hematocrit [Volume Fraction] of Blood by Automated count", True),
    ("hct", "Hematocrit [Volume Fraction] of Blood by Automated count", True),
    ("mcv", "Mean Corpuscular Volume", False),
    ("mch", "Mean Corpuscular Hemoglobin", False),
    ("mchc", "Mean Corpuscular Hemoglobin Concentration", False),
    ("rdw", "Red Cell Distribution Width", False),
    ("esr", "Erythrocyte Sedimentation Rate", False),
    ("rbc", "Red Blood Cell Count", False),
    ("hba1c", "Hemoglobin A1c/Hemoglobin.total in Blood", True),
    ("a1c", "Hemoglobin A1c/Hemoglobin.total in Blood", True),
    ("hdl", "High Density Lipoprotein Cholesterol", True),
    ("ldl", "Low Density Lipoprotein Cholesterol", True),
    ("tg", "Triglycerides", True),
    ("tgl", "Triglycerides", True),
    ("egfr", "Glomerular filtration rate/1.73 sq M.predicted", True),
    ("gfr", "Glomerular filtration rate/1.73 sq M.predicted", True),
    ("bmi", "Body Mass Index", True),
    ("sbp", "Systolic Blood Pressure", True),
    ("dbp", "Diastolic Blood Pressure", True),
    ("aec", "Eosinophils", False),
    ("tibc", "Serum Iron", False),
)
#: Words that tell a measurement if nothing better does, in the order in which they are tried.
KEYWORDS = (
    (r"\bplatelet(s)?\b", "Platelets [#/volume] in Blood by Automated count", True),
    (r"\b(leukocyte|leukocytes|white blood cell(s)?)\b", "Leukocytes [#/volume] in Blood by Automated count", True),
    (r"\b(hemoglobin|haemoglobin)\b(?!.*\ba1c\b)", "Hemoglobin [Mass/volume] in Blood", True),
    (r"\bcreatinine\b", "Creatinine", True),
    (r"\b(blood urea|serum urea)\b", "Urea Nitrogen", True),
    (r"\bpotassium\b", "Potassium", True),
    (r"\bsodium\b", "Sodium", True),
    (r"\bcalcium\b", "Calcium", True),
    (r"\bchloride\b", "Chloride", True),
    (r"\balbumin\b(?!.*\bglobulin\b)", "Albumin [Mass/volume] in Serum or Plasma", True),
    (r"\b(total cholesterol|cholesterol total)\b", "Total Cholesterol", True),
    (r"\btriglyceride(s)?\b", "Triglycerides", True),
    (r"\bneutrophil(s)?\b", "Neutrophils", False),
    (r"\blymphocyte(s)?\b", "Lymphocytes", False),
    (r"\beosinophil(s)?\b", "Eosinophils", False),
    (r"\bmonocyte(s)?\b", "Monocytes", False),
    (r"\bbasophil(s)?\b", "Basophils", False),
    (r"\buric acid\b", "Uric Acid", False),
    (r"\bvitamin d\b", "Vitamin D", False),
    (r"\bvitamin b12\b", "Vitamin B12", False),
    (r"\bferritin\b", "Ferritin", False),
)
#: Confidence of each way to tell a measurement, best first; the last is multiplied by the share of words.
WAYS = (("exact", 1.0), ("bare", 0.98), ("acronym", 0.95), ("contained", 0.92), ("keyword", 0.90), ("overlap", 0.85))
#: Letters of an alias that may be contained, share of its words that must be there, and the profile of a condition that has none.
LEAST_LETTERS, LEAST_SHARE = 5, 0.7
NO_NAME, NO_CATEGORY, NO_DESCRIPTION = "Clinical Condition", "General Clinical", "Targeted clinical management and therapeutic protocol for {}."


def measurement_names(names: DataFrame, aliases: DataFrame, acronyms: tuple = ACRONYMS, keywords: tuple = KEYWORDS) -> DataFrame:
    """``name, target, canonical, tier, confidence``: the measurement that each distinct name of a report means, or nulls.

    ``aliases`` (``alias, target, canonical, ordinal``; the alias in lower case) is a dictionary. Tried are, in this order: the
    name, the name without punctuation, acronyms as words, aliases of five letters or more that the name holds as words or
    begins with, keywords, and the alias most of whose words the name holds, at least 0.7 of them. Of several aliases of a
    tier a canonical one wins, then the lower ordinal.

    Nothing is compared with all aliases: a name asks by its words in runs as long as aliases are, and by its beginnings, in
    one equi-join. Only names left over go on to the join by shared words. Null and empty names have no target.
    """
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"[^a-z0-9\s/().\-+]", ""), r"\s+", " "))
    asked = names.select("name").where("name is not null").distinct().withColumn("c", cleaned)
    known = aliases.select("alias", "target", "canonical", F.struct(~F.col("canonical"), "ordinal").alias("rank"))
    sizes = aliases.select(F.length("alias").alias("letters"), F.size(F.split("alias", " ")).alias("words")).agg(F.collect_set("letters"), F.collect_set("words")).first()  # as many numbers as a name has letters
    letters, runs = sorted(n for n in sizes[0] if n >= LEAST_LETTERS), sorted(sizes[1])
    way = lambda i, key: F.struct(F.lit(i).alias("way"), key.alias("key"))
    keys = [F.array(way(0, F.col("c")), way(1, F.trim(F.regexp_replace("c", "[^a-z0-9 ]", ""))))]
    parts = F.split("c", " ")
    in_a_row = lambda n: F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: way(3, F.array_join(F.slice(parts, i, n), " ")))
    keys += [F.when(F.size(parts) >= n, in_a_row(n)) for n in runs]
    keys += [F.when(F.length("c") >= n, F.array(way(3, F.substring("c", 1, n)))) for n in letters]
    asks = asked.select("name", F.explode(F.flatten(F.array_compact(F.array(*keys)))).alias("k")).select("name", "k.*")
    long_enough = (F.col("way") != 3) | (F.length("key") >= LEAST_LETTERS)
    by_alias = asks.where(long_enough & (F.col("key") != "")).join(known, F.col("key") == F.col("alias")).groupBy("name").agg(F.min(F.struct("way", "rank", "target", "canonical")).alias("m"))
    words = F.regexp_extract_all("c", F.lit(r"\b[a-z0-9+-]+\b"), 0)
    meant = lambda i, table: F.array(*[F.struct(F.lit(i).alias("way"), F.lit(t).alias("target"), F.lit(c).alias("canonical")) for _, t, c in table])
    short = F.array(*[F.lit(a) for a, _, _ in acronyms])
    acronym = F.try_element_at(meant(2, acronyms), F.nullif(F.array_position(short, F.get(F.array_intersect(short, words), F.lit(0))).cast("int"), F.lit(0)))
    keyword = F.try_element_at(meant(4, keywords), F.coalesce(*[F.when(F.col("c").rlike(p), F.lit(i)) for i, (p, _, _) in enumerate(keywords, 1)]))
    met = F.when(F.col("m").isNotNull(), F.struct("m.way", "m.target", "m.canonical"))
    first = lambda *ways: F.array_min(F.array_compact(F.array(*ways)))
    direct = stored(asked.join(by_alias, "name", "left").select("name", "c", first(met, acronym, keyword).alias("d")))

    rest = direct.where("d is null").select("name", F.explode(F.array_distinct(words)).alias("word"))
    spelled = known.withColumn("of", F.array_distinct(F.regexp_extract_all("alias", F.lit(r"\b[a-z0-9]+\b"), 0))).withColumn("n", F.size("of"))
    shared = rest.join(spelled.withColumn("word", F.explode("of")), "word").groupBy("name", "alias", "rank", "target", "canonical").agg((F.count("*") / F.max("n")).alias("share"))
    most = shared.where(F.col("share") >= LEAST_SHARE).groupBy("name").agg(F.min(F.struct((-F.col("share")).alias("neg"), "rank", "target", "canonical")).alias("o"))
    tier, sure = (F.element_at(F.array(*[F.lit(w[i]) for w in WAYS]), F.col("d.way") + 1) for i in (0, 1))
    known_ = F.col("d").isNotNull()
    pick = lambda a, b: F.when(known_, a).otherwise(b)
    by_words = F.when(F.col("o").isNotNull(), F.lit(WAYS[-1][0]))
    found = direct.join(most, "name", "left")
    return found.select("name", pick(F.col("d.target"), F.col("o.target")).alias("target"), pick(F.col("d.canonical"), F.col("o.canonical")).alias("canonical"), pick(tier, by_words).alias("tier"), pick(sure, F.round(WAYS[-1][1] * -F.col("o.neg"), 2)).alias("confidence"))


def condition_profiles(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """``name, profile, tier`` and ``category, description, emergency`` of every distinct condition asked for.

    ``profiles`` (``profile, ordinal, category, description, emergency``) is a dictionary. A condition takes the profile of its
    name, else of its name in any case without outer blanks, else that of the lowest ordinal whose name holds the condition's
    or is held by it; a condition without any gets a general profile under its own name. Null and empty names are one
    condition without a name. Names that hold one another meet by the first three letters of the shorter one, so that
    conditions are not compared with all profiles and none is missed; a condition that is blank is held by every profile.
    """
    asked = names.select(F.when(F.coalesce("name", F.lit("")) == "", NO_NAME).otherwise(F.col("name")).alias("name")).distinct().withColumn("f", F.lower(F.trim("name")))
    known = profiles.select("profile", "ordinal", F.lower("profile").alias("pf"))
    lead = lambda c: F.substring(c, 1, 3)
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, (0, 1, 2, 3))), lambda n: F.substring(c, i, n)))))
    hit = lambda f, tier: f.select("name", F.struct(F.lit(tier).alias("tier"), "ordinal", "profile").alias("m"))
    found = hit(asked.join(known, F.col("name") == F.col("profile")), 0).unionByName(hit(asked.join(known, F.col("f") == F.col("pf")), 1))
    held = asked.withColumn("g", F.explode(grams(F.col("f")))).join(known.withColumn("h", lead(F.col("pf"))), (F.col("g") == F.col("h")) & F.col("f").contains(F.col("pf")))
    holds = asked.withColumn("g", lead(F.col("f"))).join(known.withColumn("h", F.explode(grams(F.col("pf")))), (F.col("g") == F.col("h")) & F.col("pf").contains(F.col("f")))
    best = found.unionByName(hit(held, 2)).unionByName(hit(holds, 2)).groupBy("name").agg(F.min("m").alias("m"))
    facts = profiles.select(F.col("profile").alias("_p"), F.col("ordinal").alias("_o"), "category", "description", "emergency")
    whole = asked.select("name").join(best, "name", "left").join(facts, (F.col("m.profile") == F.col("_p")) & (F.col("m.ordinal") == F.col("_o")), "left")
    none = F.col("m").isNull()
    own = F.concat(F.lit(NO_DESCRIPTION.split("{}")[0]), "name", F.lit(NO_DESCRIPTION.split("{}")[1]))
    tier = F.when(none, "general").otherwise(F.element_at(F.array(F.lit("exact"), F.lit("folded"), F.lit("contained")), F.col("m.tier") + 1))
    either = lambda c, default: F.when(none, default).otherwise(F.col(c)).alias(c)
    return whole.select("name", F.coalesce("m.profile", "name").alias("profile"), tier.alias("tier"), either("category", F.lit(NO_CATEGORY)), either("description", own), either("emergency", F.lit(False)))


def tiered(names: DataFrame, canon: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """``name, canonical, tier, confidence``: the best tier at which each distinct name meets a canonical one, or nulls.

    ``canon`` (``canonical, ordinal``) is a dimension; of equally good matches the lower ordinal wins. Exact, case-folded
    and squeezed names meet by equi-joins; the rest by a shared word, so names are never all compared with all.
    """
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    asked = names.select("name").distinct()
    left = asked.select("name", F.lower(F.trim("name")).alias("_f"), squeeze("name").alias("_s"), content_tokens(tokens(normalised(F.col("name")))).alias("_w"))
    right = canon.select("canonical", "ordinal", F.lower(F.trim("canonical")).alias("_cf"), squeeze("canonical").alias("_cs"), content_tokens(tokens(normalised(F.col("canonical")))).alias("_cw"))
    hit = lambda f, tier, c: f.select("name", "canonical", "ordinal", F.lit(tier).alias("tier"), c.alias("confidence"))
    level = lambda t: F.lit(TIERS[t])
    found = hit(left.join(right, F.col("name") == F.col("canonical")), "exact", level("exact"))
    found = found.unionByName(hit(left.join(right, F.col("_f") == F.col("_cf")), "folded", level("folded")))
    found = found.unionByName(hit(left.join(right, (F.col("_s") == F.col("_cs")) & (F.col("_s") != "")), "squeezed", level("squeezed")))
    by_word = left.withColumn("_k", F.explode(F.array_distinct("_w"))).join(right.withColumn("_ck", F.explode(F.array_distinct("_cw"))), F.col("_k") == F.col("_ck"))
    inside = F.concat(F.lit(" "), F.concat_ws(" ", "_w"), F.lit(" ")).contains(F.concat(F.lit(" "), F.concat_ws(" ", "_cw"), F.lit(" ")))
    found = found.unionByName(hit(by_word.where(inside), "contained", level("contained")))
    around = F.concat(F.lit(" "), F.concat_ws(" ", "_cw"), F.lit(" ")).contains(F.concat(F.lit(" "), F.concat_ws(" ", "_w"), F.lit(" ")))
    found = found.unionByName(hit(by_word.where(around & (F.length(F.concat_ws(" ", "_w")) >= 5)), "within", level("within")))
    share = overlap(F.col("_w"), F.col("_cw"))
    found = found.unionByName(hit(by_word.where(share >= least_overlap), "overlap", F.round(level("overlap") * share, 6)))
    best = found.groupBy("name").agg(F.max(F.struct("confidence", (-F.col("ordinal")).alias("neg"), "canonical", "tier")).alias("m"))
    return asked.join(best, "name", "left").select("name", "m.canonical", "m.tier", "m.confidence")


def cached(names: DataFrame, cache: DataFrame) -> DataFrame:
    """``name, status, detail`` of each distinct name from a cache (``key, status, detail``); ``MISS`` where it has no entry.

    Entries that say that nothing was found count as answers. Keys are names in lower case without outer blanks.
    """
    asked = names.select(F.lower(F.trim("name")).alias("key")).where("key <> ''").distinct()
    return asked.join(cache, "key", "left").select(F.col("key").alias("name"), F.coalesce("status", F.lit("MISS")).alias("status"), "detail")


def first_date(text: Column) -> Column:
    """The date of a report: the first place of ``DATE_PLACES`` that reads as a date from 1990 on in one of the formats; null for none."""
    tried = []
    for place in DATE_PLACES:
        found = F.regexp_replace(F.trim(F.nullif(F.regexp_extract(text, place, 1), F.lit(""))), r"\s+", " ")
        named = "[A-Za-z]" in place
        for fmt in DATE_FORMATS:
            if ("MMM" in fmt) == named:
                tried.append(F.try_to_timestamp(found, F.lit(fmt)).cast("date"))
    plausible = [F.when(F.year(d).between(1990, F.year(F.current_date()) + 1), d) for d in tried]
    return F.coalesce(*plausible)


def combined_atoms(atoms: Column) -> Column:
    """Distinct atoms in order, without bare codes for which an atom with a value is there."""
    with_value = F.transform(F.filter(atoms, lambda a: a.contains("_@_")), lambda a: F.substring_index(a, "_@_", 1))
    return F.filter(F.array_distinct(atoms), lambda a: a.contains("_@_") | ~F.array_contains(with_value, a))


def prompts(rules: list[tuple[Column, str]], most: int = 4) -> Column:
    """Texts of the rules that hold, in order, each once, at most ``most``."""
    said = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(said), 1, most)


def category(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    """The first category whose pattern occurs in a text."""
    out = F.lit(otherwise)
    for name, pattern in reversed(patterns.items()):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def protocols(frame: DataFrame, templates: list[tuple[str, Column, float]], key: str = "entity") -> DataFrame:
    """``key, name, score``: a row for every template whose condition holds; one pass over the rows."""
    all_ = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))) for n, c, s in templates])
    return frame.select(key, F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("t")).select(key, "t.name", "t.score")


def profile(frame: DataFrame) -> DataFrame:
    """``frame`` with ``gender`` in one spelling and ``email`` in lower case without outer blanks."""
    g = F.lower(F.trim(F.coalesce("gender", F.lit(""))))
    one = F.when(g.isin("m", "male", "man"), "male").when(g.isin("f", "female", "woman"), "female").when(g == "", None).otherwise("other")
    return frame.withColumn("gender", one).withColumn("email", F.nullif(F.lower(F.trim("email")), F.lit("")))
