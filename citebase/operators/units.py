"""Quantities recorded in different units: every value of a numeric spec in the unit of its vocabulary row.

The whole operator is SQL expressions: number and unit are cut out of the quote, the unit's spelling is normalised by a
join with the alias table, the unit is the quote's, else the one of a text value, else the unit field, else the default
of the spec, and value * factor + offset is applied.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citebase.functions.text import fold
from citebase.operators.vocabulary import with_spec_key
from citebase.session import small

#: Unit, quantity, factor and offset to the quantity's base unit, spellings.
UNITS: list[tuple[str, str, float, float, list[str]]] = [
    ("mm", "length", 1.0, 0.0, ["mm", "mm.", "millimeter", "milimeter", "millimetre", "millimètre", "millimeters"]),
    ("cm", "length", 10.0, 0.0, ["cm", "cm.", "centimeter", "centimetre", "centimètre"]),
    ("dm", "length", 100.0, 0.0, ["dm", "decimeter"]),
    ("m", "length", 1000.0, 0.0, ["m", "m.", "mtr", "mtr.", "meter", "metre", "mètre"]),
    ("in", "length", 25.4, 0.0, ["in", "in.", "inch", "inches", '"', "″", "''", "”"]),
    ("ft", "length", 304.8, 0.0, ["ft", "ft.", "foot", "feet"]),
    ("kg/m2", "areal mass", 1.0, 0.0, ["kg/m2", "kg/m²", "kg per m2", "kg per m²", "kg m-2", "kg·m-2"]),
    ("g/m2", "areal mass", 0.001, 0.0, ["g/m2", "g/m²", "gr/m2", "gr/m²", "gram/m2", "gram/m²", "gsm"]),
    ("kg/m3", "density", 1.0, 0.0, ["kg/m3", "kg/m³", "kg per m3", "kg per m³", "kg m-3", "kg·m-3"]),
    ("g/cm3", "density", 1000.0, 0.0, ["g/cm3", "g/cm³", "gr/cm3", "gr/cm³"]),
    ("kg/l", "density", 1000.0, 0.0, ["kg/l", "kg/liter"]),
    ("kg/dm3", "density", 1000.0, 0.0, ["kg/dm3", "kg/dm³"]),
    ("t/m3", "density", 1000.0, 0.0, ["t/m3", "t/m³", "ton/m3", "ton/m³"]),
    ("dB", "level", 1.0, 0.0, ["db", "db(a)", "decibel"]),
    ("%", "share", 1.0, 0.0, ["%", "pct", "pct.", "procent", "percent", "prozent", "pour cent", "per cent"]),
    ("1", "share", 100.0, 0.0, ["-", "fraction", "fractie", "1"]),
    ("min", "time", 1.0, 0.0, ["min", "min.", "mins", "minuten", "minutes", "minute", "minuut"]),
    ("s", "time", 1 / 60, 0.0, ["s", "s.", "sec", "sec.", "seconds", "seconden", "sekunden", "secondes"]),
    ("h", "time", 60.0, 0.0, ["h", "h.", "hrs", "hours", "uur", "std.", "std", "stunden", "heures"]),
    ("°C", "temperature", 1.0, 0.0, ["°c", "° c", "℃", "degc", "graden celsius", "degrees celsius", "grad celsius"]),
    ("K", "temperature", 1.0, -273.15, ["k", "kelvin"]),
    ("°F", "temperature", 5 / 9, -160 / 9, ["°f", "° f", "℉", "degf", "f", "degrees fahrenheit", "graden fahrenheit"]),
    ("kPa", "pressure", 1.0, 0.0, ["kpa", "kilopascal"]),
    ("kN/m2", "pressure", 1.0, 0.0, ["kn/m2", "kn/m²"]),
    ("Pa", "pressure", 0.001, 0.0, ["pa", "pascal"]),
    ("N/m2", "pressure", 0.001, 0.0, ["n/m2", "n/m²"]),
    ("hPa", "pressure", 0.1, 0.0, ["hpa"]),
    ("mbar", "pressure", 0.1, 0.0, ["mbar"]),
    ("bar", "pressure", 100.0, 0.0, ["bar"]),
    ("MPa", "pressure", 1000.0, 0.0, ["mpa", "megapascal"]),
    ("W/mK", "conductivity", 1.0, 0.0, ["w/mk", "w/(m·k)", "w/(mk)", "w/m k", "w/m.k", "w/m·k"]),
    ("mW/mK", "conductivity", 0.001, 0.0, ["mw/mk", "mw/(m·k)", "mw/(mk)", "mw/m k", "mw/m.k", "mw/m·k"]),
    ("W/cmK", "conductivity", 100.0, 0.0, ["w/cmk", "w/(cm·k)", "w/(cmk)", "w/cm k", "w/cm.k", "w/cm·k"]),
    ("m2K/W", "resistance", 1.0, 0.0, ["m2k/w", "m²k/w", "m²·k/w", "m2.k/w", "m2·k/w", "m2 k/w"]),
    ("cm2K/W", "resistance", 0.0001, 0.0, ["cm2k/w", "cm²k/w", "cm²·k/w", "cm2.k/w", "cm2·k/w"]),
    ("kg CO2-eq/m2", "footprint", 1.0, 0.0, ["kg co2-eq/m2", "kg co2-eq/m²", "kg co₂e/m²", "kg co2e/m2", "kgco2eq/m2", "kg co2/m²", "kg co2/m2"]),
    ("g CO2-eq/m2", "footprint", 0.001, 0.0, ["g co2-eq/m2", "g co₂e/m²", "g co2e/m2", "gco2eq/m2", "gram co2/m²", "gram co2/m2", "g co2/m²"]),
    ("MJ/m2", "areal energy", 1.0, 0.0, ["mj/m2", "mj/m²", "megajoule per m²", "megajoule per m2"]),
    ("GJ/m2", "areal energy", 1000.0, 0.0, ["gj/m2", "gj/m²"]),
    ("kWh/m2", "areal energy", 3.6, 0.0, ["kwh/m2", "kwh/m²"]),
    ("m3/h", "flow", 1.0, 0.0, ["m3/h", "m³/h", "m³/uur", "m3/uur", "cbm/h"]),
    ("l/s", "flow", 3.6, 0.0, ["l/s", "liter/s"]),
    ("l/min", "flow", 0.06, 0.0, ["l/min", "liter/min"]),
    ("ug/m3", "concentration", 1.0, 0.0, ["ug/m3", "ug/m³", "µg/m³", "μg/m3", "µg/m3", "μg/m³", "mcg/m3", "mcg/m³"]),
    ("mg/m3", "concentration", 1000.0, 0.0, ["mg/m3", "mg/m³"]),
    ("ng/m3", "concentration", 0.001, 0.0, ["ng/m3", "ng/m³"]),
]

#: Phrases that tell the language of a quote.
LANGUAGE_CUES = {
    "en": r"the|has|of|for|maker|gives|than|enough|width|length|height|thickness|depth|density|weight|sound|noise|reduction|fire|wind|load|pressure|thermal|air|content|energy|emission|humidity|reflectance|temperature|perforation|measured|climate|conductivity|resistance|permeability|formaldehyde|absorption",
    "fr": r"le|la|du|une|selon|fabricant|pour|avec|affiche|vaut|suffit|est|épaisseur|largeur|longueur|hauteur|masse|densité|réflexion|humidité|résistance|température|charge|pression|conductivité|énergie|perméabilité|émission|absorption|mesuré",
    "nl": r"de|het|een|heeft|volgens|haalt|voor|geldt|met|ruim|dikte|breedte|lengte|modulebreedte|modulelengte|afhanghoogte|hoogte|voegbreedte|gewicht|dichtheid|geluidreductie|luchtgeluidisolatie|geluidsabsorptie|lichtreflectie|luchtvochtigheid|perforatiegraad|gehalte|brandwerendheid|gebruikstemperatuur|belasting|winddruk|warmtegeleidingscoëfficiënt|warmteweerstand|energie|luchtdoorlatendheid|emissie|gemeten",
}

#: Thousands are grouped by a point in Dutch and German, a comma in English, a space in French.
_GROUPED = r"\d{1,3}(?:[.,    ]\d{3})+(?![\d/])(?:[.,]\d+)?"
NUMBER = rf"(?:{_GROUPED}|\d+[   ]\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)?)"
_SPACE = r"[\s\u00a0\u202f\u2009]"
_BETWEEN = rf"(?:{_SPACE}*(?:-|–|—|\.\.\.?){_SPACE}*|{_SPACE}+(?:tot en met|tot|to|bis|jusqu['’]à|à|until|and|en|und|et){_SPACE}+)"


def unit_table(spark) -> DataFrame:
    """(alias, unit, quantity, factor, offset); a fixed table, a few rows for each unit."""
    rows = {(a, u, q, f, o) for u, q, f, o, names in UNITS for a in names}
    return spark.createDataFrame(sorted(rows), "alias string, unit_id string, quantity string, factor double, offset double")


def _measure() -> str:
    names = sorted({a for *_, names in UNITS for a in names if a not in ("-", "1")}, key=len, reverse=True)
    unit = "|".join(re.escape(a).replace(r"\ ", _SPACE) for a in names)
    return rf"(?iu)(?<![\p{{L}}\d.,/-])[-−]?({NUMBER})(?:{_BETWEEN}({NUMBER}))?{_SPACE}*({unit})?(?![\p{{L}}\d²³])"


def language(quote: Column) -> Column:
    """nl, en or fr by the words of the quote, de where none of theirs occurs; German and Dutch group digits alike."""
    count = lambda lang: F.regexp_count(F.lower(quote), F.lit(rf"(?U)\b(?:{LANGUAGE_CUES[lang]})\b"))
    en, fr, nl = count("en"), count("fr"), count("nl")
    return F.when((en > fr) & (en > nl), "en").when((fr > nl) & (fr >= en), "fr").otherwise("nl")


def number(text: Column, lang: Column) -> Column:
    """The value of a number as written in a language, fractions included; null for null or no number."""
    t = F.regexp_replace(text, r"[   ]", " ")
    fraction = F.regexp_extract(t, r"^(?:(\d+) )?(\d+)/(\d+)$", 3) != ""
    part = lambda i: F.regexp_extract(t, r"^(?:(\d+) )?(\d+)/(\d+)$", i).try_cast("double")
    # one separator with three digits after it is the only form whose reading depends on the language
    lone = F.regexp_extract(t, r"^[1-9]\d{0,2}([.,])\d{3}$", 1)
    grouping = F.when(lang == "en", lone == ",").when(lang == "fr", F.lit(False)).otherwise(lone == ".")
    last = F.regexp_extract(t, r"([.,])\d+$", 1)
    several = F.regexp_count(t, F.lit(r"[.,]")) > 1
    same = F.regexp_extract(t, r"^\d+([.,])\d{3}(?:\1\d{3})+$", 1) != ""
    plain = F.regexp_replace(t, r"[ .,]", "")
    decimal = F.concat(F.regexp_replace(F.regexp_replace(t, r"[.,]\d+$", ""), r"[ .,]", ""), F.lit("."), F.regexp_extract(t, r"[.,](\d+)$", 1))
    text_value = F.when(last == "", plain).when(lone != "", F.when(grouping, plain).otherwise(decimal)).when(several & same, plain).otherwise(decimal)
    return F.when(fraction, F.coalesce(part(1), F.lit(0.0)) + part(2) / part(3)).otherwise(text_value.try_cast("double"))


def _unit_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s  ]+", " "))


def convert_claims(claims: DataFrame, spec_attributes: DataFrame) -> DataFrame:
    """Every stated numeric value of a numeric spec, with its unit and its value in the spec's unit.

    Columns: answer_claim_id, spec_key (resolved), field_name (value_numeric or value_numeric_max), stated, stated_unit,
    common_value, status: ``convert`` (still to be converted), ``common`` (already in the common unit, however spelled and wherever it stands), ``converted``
    (the field holds another number than the one stated), ``unknown`` (no number or a unit of another quantity).
    Claims without a numeric spec give no row; null and empty quotes fall back on value_text and the unit field.
    Repeated rows are kept. What is broadcast is the fixed unit table and, behind a check of its length, the vocabulary.
    """
    spark = claims.sparkSession
    units = unit_table(spark)
    specs = spec_attributes.where("data_type in ('numeric', 'numeric_range')").select("spec_key", _unit_key(F.coalesce("unit", F.lit("1"))).alias("alias"))
    target = small(specs.join(F.broadcast(units), "alias").select(F.col("spec_key").alias("resolved"), F.col("unit_id").alias("to_id"), F.col("quantity").alias("to_quantity"), F.col("factor").alias("to_factor"), F.col("offset").alias("to_offset")))
    base = claims.select("answer_claim_id", "product_name", "spec_key", "value_numeric", "value_numeric_max", "value_text", F.col("unit").alias("unit_field"), "source_quote")
    base = base.where("value_numeric is not null or value_numeric_max is not null or value_text is not null")
    own = with_spec_key(base, "spec_key", spec_attributes).join(target, "resolved")
    name = F.when(F.length(F.trim("product_name")) > 2, F.trim("product_name"))
    quote = F.coalesce(F.replace("source_quote", name, F.lit(" ¤ ")), "source_quote", F.lit(""))
    # a further measure in brackets at the end is a condition
    quote = F.regexp_replace(quote, r"\s*\([^()]*\d[^()]*\)[\s.]*$", "")
    quote = F.regexp_replace(quote, r"(?i)A1\s?[-–]\s?A3", "")
    cut = lambda c, i: F.nullif(F.regexp_extract(c, _measure(), i), F.lit(""))
    # the language only matters to numbers with one separator before three digits
    own = own.withColumn("q", quote).withColumn("lang", F.when(F.regexp_like("q", F.lit(r"[1-9]\d{0,2}[.,]\d{3}(?!\d)")), language(F.col("q"))))
    own = own.withColumn("in_text", F.col("value_numeric").isNull() & F.col("value_text").isNotNull())
    # one search of the quote, its parts from what it found
    own = own.withColumn("found", F.regexp_extract("q", _measure(), 0))
    own = own.withColumns({"s1": cut(F.col("found"), 1), "s2": cut(F.col("found"), 2), "u": cut(F.col("found"), 3)})
    own = own.withColumn("t1", F.when(F.col("in_text"), cut(F.col("value_text"), 1))).withColumn("tu", F.when(F.col("in_text"), cut(F.col("value_text"), 3)))
    stated1 = F.coalesce(number(F.col("s1"), F.col("lang")), number(F.col("t1"), F.col("lang")))
    own = own.withColumn("stated1", stated1).withColumn("stated2", number(F.col("s2"), F.col("lang")))
    # a share without a unit in the text is a share of one, whatever the unit field says
    rest = F.when(F.col("to_quantity") == "share", F.lit("1")).otherwise(F.col("unit_field"))
    own = own.withColumn("key", _unit_key(F.coalesce("u", "tu", rest)))
    from_ = units.select(F.col("alias").alias("key"), "unit_id", "quantity", "factor", "offset")
    own = own.join(F.broadcast(from_), "key", "left")
    fits = F.col("key").isNull() | (F.col("quantity") == F.col("to_quantity"))
    own = own.withColumn("unit_id", F.when(F.col("key").isNull(), F.col("to_id")).otherwise(F.col("unit_id")))
    factor, offset = F.coalesce("factor", "to_factor"), F.coalesce("offset", "to_offset")
    convert = lambda v: (v * factor + offset - F.col("to_offset")) / F.col("to_factor")
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-6), F.abs(b) * 1e-6)

    def status(field: str, stated: Column) -> Column:
        same = F.col("unit_id") == F.col("to_id")
        number_given = F.when(F.lit(field == "value_numeric") & F.col("in_text"), F.lit(True)).otherwise(near(F.col(field), stated))
        return F.when(stated.isNull() | ~F.coalesce(fits, F.lit(False)), "unknown").when(~number_given, "converted").when(same, "common").otherwise("convert")

    one = F.struct(F.lit("value_numeric").alias("field_name"), F.col("stated1").alias("stated"), convert(F.col("stated1")).alias("common_value"), status("value_numeric", F.col("stated1")).alias("status"), (F.col("value_numeric").isNotNull() | F.col("in_text")).alias("given"))
    two = F.struct(F.lit("value_numeric_max").alias("field_name"), F.col("stated2").alias("stated"), convert(F.col("stated2")).alias("common_value"), status("value_numeric_max", F.col("stated2")).alias("status"), F.col("value_numeric_max").isNotNull().alias("given"))
    return own.select("answer_claim_id", F.col("resolved").alias("spec_key"), F.col("unit_id").alias("stated_unit"), F.explode(F.array(one, two)).alias("v")).where("v.given").select("answer_claim_id", "spec_key", "v.field_name", "v.stated", "stated_unit", "v.common_value", "v.status")


def values_to_convert(claims: DataFrame, spec_attributes: DataFrame) -> DataFrame:
    """(answer_claim_id, field_name, value_milli) of the values that still have to be converted."""
    out = convert_claims(claims, spec_attributes).where("status = 'convert'")
    milli = F.round(F.round(F.col("common_value") * 1000, 5)).cast("bigint")
    return out.select("answer_claim_id", "field_name", milli.alias("value_milli"))
