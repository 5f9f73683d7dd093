"""The cited-fact store: admission of facts, comparison with the truth, persistence, identity and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citebase.functions.numbers import digits_within, six_digits
from citebase.functions.similarity import jaccard, trigrams
from citebase.functions.text import normalize, quoted, slug
from citebase.operators.relational import supersede_chain
from citebase.session import SMALL

#: Least similarity of a possible duplicate and of a resolved product.
DUPLICATE, RESOLVED = 0.35, 0.45
#: From-unit, to-unit and factor of the conversions that admission knows; other pairs keep value and unit.
CONVERSIONS = [("cm", "mm", 10.0), ("m", "mm", 1000.0), ("mpa", "kpa", 1000.0), ("g/m2", "kg/m2", 0.001), ("g/m3", "kg/m3", 0.001)]
#: Plausible ranges of specs in their own unit; a misread value lies outside.
PLAUSIBLE = [
    ("fire_resistance_ei", 0.0, 240.0),
    ("thermal_conductivity_lambda", 0.001, 1.0),
    ("thermal_resistance_rd", 0.01, 20.0),
    ("rc_value", 0.01, 20.0),
    ("u_value", 0.1, 10.0),
    ("airborne_sound_reduction_rw", 10.0, 80.0),
    ("rw_c", -30.0, 20.0),
    ("rw_ctr", -30.0, 20.0),
    ("impact_sound_lnw", 10.0, 90.0),
    ("sound_absorption_alpha_w", 0.0, 1.0),
    ("thickness_mm", 0.1, 1000.0),
    ("width_mm", 1.0, 20000.0),
    ("height_mm", 1.0, 20000.0),
    ("length_mm", 1.0, 20000.0),
    ("max_height_mm", 100.0, 20000.0),
    ("density", 1.0, 3000.0),
    ("weight_per_m2", 0.1, 1000.0),
    ("compressive_strength_cs", 0.1, 10000.0),
    ("water_vapour_resistance_mu", 0.1, 100000.0),
    ("service_temp_min", -100.0, 500.0),
    ("service_temp_max", -100.0, 500.0),
    ("recycled_content_pct", 0.0, 100.0),
    ("gwp_a1a3", -1000.0, 100000.0),
    ("mki_value", 0.0, 100000.0),
]
#: Parts into which the rows of a frequent trigram are spread.
SALTS = 16
VALUES = ["value_numeric", "value_text", "value_bool", "value_enum"]


def value_count(columns: list[str] = VALUES) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def verify_claims(claims: DataFrame, ranges: DataFrame) -> DataFrame:
    """Claims with ``ok``, ``reason`` and the stored value, upper value and unit.

    claims: presence, source_snippet, page_number, page_text, the value columns, value_numeric_max, unit, target_unit,
    spec_key, derivation_note; ranges: spec_key, low, high of plausible values. The order of the checks decides the reason.
    Digits are checked for stated values only; an unknown pair of units keeps the value and its unit.
    """
    spark = claims.sparkSession
    conversions = spark.createDataFrame(CONVERSIONS, "_from string, _to string, _factor double")
    c = claims.withColumn("_from", F.lower(F.trim("unit"))).withColumn("_to", F.lower(F.trim("target_unit")))
    c = c.join(F.broadcast(conversions), ["_from", "_to"], "left").join(ranges, "spec_key", "left")
    cited, silent = F.col("presence").isin("stated", "derived"), F.col("presence") == "not_stated"
    factor = F.coalesce("_factor", F.lit(1.0))
    value, upper = F.col("value_numeric") * factor, F.col("value_numeric_max") * factor
    outside = lambda v: F.coalesce((v < F.col("low")) | (v > F.col("high")), F.lit(False))
    stated = F.col("presence") == "stated"
    digits_missing = lambda v: F.coalesce(stated & F.col(v).isNotNull() & ~digits_within(F.col(v), F.col("source_snippet")), F.lit(False))
    reason = (
        F.when(silent, None)
        .when(cited & (F.coalesce("source_snippet", F.lit("")) == "") | cited & F.col("page_number").isNull(), "no citation")
        .when(cited & F.col("page_text").isNull(), "no page text")
        .when(cited & ~quoted(F.col("page_text"), F.col("source_snippet")), "not verbatim")
        .when(cited & (value_count() != 1), "not one value")
        .when(digits_missing("value_numeric"), "digits not in quote")
        .when(F.col("value_numeric").isNotNull() & digits_missing("value_numeric_max"), "upper digits not in quote")
        .when(outside(value) | outside(upper), "implausible")
    )
    keep = lambda x: F.when(~silent, x)
    return c.withColumn("reason", reason).select(
        *(x for x in claims.columns if x not in ("value_numeric", "value_numeric_max", "unit", "derivation_note", "page_text", "value_text", "value_bool", "value_enum")),
        F.col("reason").isNull().alias("ok"),
        "reason",
        keep(value).alias("value_numeric"),
        keep(upper).alias("value_numeric_max"),
        keep(F.when(F.col("_factor").isNotNull(), F.col("target_unit")).otherwise(F.col("unit"))).alias("unit"),
        *(keep(F.col(v)).alias(v) for v in ("value_text", "value_bool", "value_enum")),
        F.when(F.col("presence") == "derived", F.col("derivation_note")).alias("derivation_note"),
    )


def admit_claims(claims: DataFrame, attributes: DataFrame) -> DataFrame:
    """(answer_claim_id, reason): ``admitted`` or the first check that an extracted claim fails.

    claims: answer_claim_id, answer_text, source_quote, spec_key and values; attributes: spec_key, data_type. Order: the
    quote stands in the answer, its digits hold the value, the key is known, the value is of the key's type.
    """
    c = claims.join(attributes.select("spec_key", "data_type"), "spec_key", "left")
    quote = normalize(F.coalesce("source_quote", F.lit("")))
    verbatim = (quote != "") & F.coalesce(quoted(F.col("answer_text"), F.col("source_quote")), F.lit(False))
    typed = (
        F.when(F.col("data_type").isin("numeric", "numeric_range"), F.col("value_numeric").isNotNull())
        .when(F.col("data_type") == "boolean", F.col("value_bool").isNotNull())
        .when(F.col("data_type") == "enum", F.coalesce("value_enum", F.lit("")) != "")
        .otherwise(F.coalesce("value_text", F.lit("")) != "")
    )
    reason = (
        F.when(~verbatim, "not verbatim")
        .when(F.col("value_numeric").isNotNull() & ~digits_within(F.col("value_numeric"), F.col("source_quote")), "digits not in quote")
        .when(F.col("data_type").isNull(), "unknown key")
        .when(~typed, "no value of the type")
        .otherwise("admitted")
    )
    return c.select("answer_claim_id", reason.alias("reason"))


def display_value() -> Column:
    """A claim's value for a report: number with upper end and unit, else text, yes or no, class, else a dash."""
    number = F.concat(six_digits(F.col("value_numeric")), F.coalesce(F.concat(F.lit("-"), six_digits(F.col("value_numeric_max"))), F.lit("")), F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")))
    return F.coalesce(number, "value_text", F.when(F.col("value_bool"), "yes").when(~F.col("value_bool"), "no"), "value_enum", F.lit("-"))


def values_match(data_type: Column, claim: dict[str, Column], truth: dict[str, Column], tolerance: Column) -> Column:
    """Whether a claim's value is that of the truth, by the attribute's type; an upper end of 0 counts as none."""
    t = F.coalesce(tolerance.cast("double"), F.lit(0.0))
    high = F.coalesce(F.nullif(truth["value_numeric_max"], F.lit(0.0)), truth["value_numeric"])
    same = lambda c: (normalize(claim[c]) != "") & (normalize(claim[c]) == normalize(F.coalesce(truth[c], F.lit(""))))
    hit = (
        F.when(data_type.isin("numeric", "numeric_range"), (claim["value_numeric"] >= truth["value_numeric"] - t) & (claim["value_numeric"] <= high + t))
        .when(data_type == "boolean", claim["value_bool"] == truth["value_bool"])
        .when(data_type == "enum", same("value_enum"))
        .otherwise(same("value_text"))
    )
    return F.coalesce(hit, F.lit(False))


def diff_claims(claims: DataFrame, attributes: DataFrame, truth: DataFrame) -> DataFrame:
    """(claim_id, verdict, confusable_key) against the current truth.

    claims: claim_id, product_id (null: not resolved), spec_key and values in common units; attributes: spec_key, data_type,
    comparison_tolerance, confusable_with; truth: product_id, spec_key, presence and values, one row for a key. Verdicts:
    unverifiable_product, unverifiable_spec, correct, likely_confusion (the first confusable key that matches), incorrect.
    """
    names = ["value_numeric", "value_numeric_max", "value_text", "value_bool", "value_enum"]
    side = lambda p: {n: F.col(f"{p}{n}") for n in names}
    kinds = attributes.select("spec_key", "data_type", "comparison_tolerance", "confusable_with")
    facts = truth.select("product_id", "spec_key", F.col("presence").alias("t_presence"), *(F.col(n).alias(f"t_{n}") for n in names))
    c = claims.select("claim_id", "product_id", "spec_key", *(F.col(n).alias(f"c_{n}") for n in names)).join(kinds, "spec_key", "left")
    direct = c.join(facts, ["product_id", "spec_key"], "left")
    known = F.col("t_presence").isNotNull() & (F.col("t_presence") != "not_stated")
    direct = direct.withColumn("_known", known).withColumn("_match", known & values_match(F.col("data_type"), side("c_"), side("t_"), F.col("comparison_tolerance")))
    others = c.where("product_id is not null").select("claim_id", "product_id", *(f"c_{n}" for n in names), F.posexplode("confusable_with").alias("_pos", "other"))
    other_kinds = attributes.select(F.col("spec_key").alias("other"), "data_type", "comparison_tolerance")
    hits = others.join(other_kinds, "other").join(facts.withColumnRenamed("spec_key", "other"), ["product_id", "other"])
    hits = hits.where(F.col("t_presence") != "not_stated").where(values_match(F.col("data_type"), side("c_"), side("t_"), F.col("comparison_tolerance")))
    first = hits.groupBy("claim_id").agg(F.min_by("other", "_pos").alias("confused"))
    out = direct.join(first, "claim_id", "left")
    verdict = (
        F.when(F.col("product_id").isNull(), "unverifiable_product")
        .when(~F.coalesce("_known", F.lit(False)), "unverifiable_spec")
        .when(F.col("_match"), "correct")
        .when(F.col("confused").isNotNull(), "likely_confusion")
        .otherwise("incorrect")
    )
    return out.select("claim_id", verdict.alias("verdict"), F.when(verdict == "likely_confusion", F.col("confused")).alias("confusable_key"))


def persist_claims(log: DataFrame, keys: list[str], order: list[str], id_column: str, values: list[str], slices: Column | None = None) -> DataFrame:
    """What becomes of each verified claim in order: ``insert``, ``supersede`` or ``no-op``, and the chain of those kept.

    A claim equal to the one before it in all values changes nothing; unit and confidence play no part. ``slices`` spreads
    busy keys, as in the chain.
    """
    marks = ["superseded_by", "is_current", "is_first"]
    changes = supersede_chain(log, keys, order, id_column, values, slices)
    kept = supersede_chain(changes.where("is_change").drop(*marks, "is_change"), keys, order, id_column, slices=slices)
    stored = kept.withColumn("action", F.when(F.col("is_first"), "insert").otherwise("supersede"))
    same = changes.where("not is_change").drop("is_change")
    noop = same.withColumns({"superseded_by": F.lit(None).cast(log.schema[id_column].dataType), "is_current": F.lit(False), "is_first": F.lit(False), "action": F.lit("no-op")})
    return stored.unionByName(noop)


def store_claims(claims: DataFrame, known: DataFrame, keys: list[str], order: list[str], id_column: str, values: list[str], slices: Column | None = None) -> DataFrame:
    """From extracted claims to the store: unknown keys dropped, quotes held against their page, the rest written in order.

    claims: spec_key, source_quote, page_text and values; known: spec_key. What is not quoted verbatim is not stored.
    """
    cited = (F.col("source_quote") != "") & quoted(F.col("page_text"), F.col("source_quote"))
    kept = claims.join(known.select("spec_key").distinct(), "spec_key", "left_semi").where(F.coalesce(cited, F.lit(False)))
    return persist_claims(kept.drop("page_text", "source_quote"), keys, order, id_column, values, slices)


def product_identity(rows: DataFrame, name: str, order: str, backfill: list[str]) -> DataFrame:
    """One product for each slug of its name, other columns from the earliest row that has them: filled, never overwritten."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in backfill]
    return rows.withColumn("slug", slug(F.col(name))).groupBy("slug").agg(F.min_by(name, order).alias(name), F.count("*").alias("rows"), *firsts)


def _prefix(grams: Column, threshold: float, order: Column) -> Column:
    """The rarest trigrams of which two sets of the given similarity share one at least."""
    keep = F.size(grams) - F.ceil(F.size(grams) * threshold - 1e-9) + 1
    return F.slice(order, 1, keep.cast("int"))


def similar_pairs(names: DataFrame, block: list[str], threshold: float = DUPLICATE, id_column: str = "id", name: str = "name") -> DataFrame:
    """(id_a, id_b, similarity), a < b, of the names of a block whose trigram similarity reaches the threshold.

    Candidates share one of their rarest trigrams (prefix filter): exact, and a frequent trigram makes no block. Rows of one
    name and block are compared once, as their least id. Blocks with a null column are one block.
    """
    n = names.select(*block, id_column, name).where(F.col(name).isNotNull())
    n = n.groupBy(*block, name).agg(F.min(id_column).alias("id")).withColumn("grams", trigrams(F.col(name))).where(F.size("grams") > 0)
    each = n.select(*block, "id", F.explode("grams").alias("gram"))
    # a frequent trigram is one key of many rows: its count goes to each of its salts
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    frequency = each.groupBy("gram").count().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ranked = each.withColumn("salt", salt).join(frequency, ["gram", "salt"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("order"))
    full = n.join(ranked, "id").select(*block, "id", F.col(name).alias("name"), "grams", F.explode(F.transform(_prefix(F.col("grams"), threshold, F.col("order")), lambda s: s["gram"])).alias("gram"))
    a, b = full.alias("a"), full.alias("b")
    same = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id"))
    for c in block:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    least = F.size("a.grams") >= threshold * F.size("b.grams") - 1e-9
    most = F.size("b.grams") >= threshold * F.size("a.grams") - 1e-9
    pairs = a.join(b, same & least & most).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.grams").alias("ga"), F.col("b.grams").alias("gb")).dropDuplicates(["id_a", "id_b"])
    return pairs.withColumn("similarity", jaccard(F.col("ga"), F.col("gb"))).where(F.col("similarity") >= threshold - 1e-12).select("id_a", "id_b", "similarity")


def best_match(entered: DataFrame, names: DataFrame) -> DataFrame:
    """(entered, name, score) of the most similar name for each distinct entered text, null where no trigram is shared.

    Names are the short canonical list: each distinct one holds its trigrams, and entered texts are joined with it on their
    trigrams, so what is shuffled grows with the entered texts and the names that share a trigram with them. The list's
    trigrams are broadcast if they are checked to be few; else a trigram's names are spread over salts.
    """
    e = entered.select("entered").where("entered is not null").distinct().withColumn("ge", trigrams(F.col("entered")))
    n = names.select("name").where("name is not null").distinct().withColumn("gn", trigrams(F.col("name")))
    listed = n.select("name", F.size("gn").alias("nn"), F.explode("gn").alias("gram"))
    asked = e.select("entered", F.size("ge").alias("ne"), F.explode("ge").alias("gram"))
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    if listed.limit(SMALL + 1).count() <= SMALL:
        pairs = asked.join(F.broadcast(listed), "gram")
    else:
        pairs = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, ["gram", "salt"])
    shared = pairs.groupBy("entered", "name", "ne", "nn").agg(F.count("*").alias("both"))
    score = F.col("both") / (F.col("ne") + F.col("nn") - F.col("both"))
    best = shared.groupBy("entered").agg(F.max(F.struct(score.alias("score"))).alias("b"), F.min_by("name", F.struct(-score, F.col("name"))).alias("name"))
    return e.select("entered").join(best.select("entered", "name", F.col("b.score").alias("score")), "entered", "left")


#: Checks of stored claims: name and condition of a violation.
CONSTRAINTS: list[tuple[str, str]] = [
    ("one value", "cast(value_numeric is not null as int) + cast(value_text is not null as int) + cast(value_bool is not null as int) + cast(value_enum is not null as int) <> 1"),
    ("range order", "value_numeric_max is not null and (value_numeric is null or value_numeric_max < value_numeric)"),
    ("quote given", "source_quote is null or trim(source_quote) = ''"),
    ("unit of a number", "unit is not null and value_numeric is null"),
    ("product given", "product_name is null or trim(product_name) = ''"),
]


def violations(claims: DataFrame, id_column: str, constraints: list[tuple[str, str]] = CONSTRAINTS) -> DataFrame:
    """(id, constraint) of every violated check, in one scan."""
    broken = F.filter(F.array(*(F.when(F.expr(sql), F.lit(name)) for name, sql in constraints)), lambda x: x.isNotNull())
    return claims.select(id_column, F.explode(broken).alias("constraint"))
