import pytest
from pyspark.sql import functions as F

from citebase.operators.units import convert_claims, number, values_to_convert
from citebase.operators.vocabulary import resolve_spec_keys

SPECS = "spec_key string, name_nl string, name_en string, data_type string, unit string"
CLAIMS = "answer_claim_id bigint, product_name string, spec_key string, value_numeric double, value_numeric_max double, value_text string, unit string, source_quote string"
ROWS = [
    ("thickness_mm", "Dikte", "Thickness", "numeric", "mm"),
    ("density", "Dichtheid", "Density", "numeric", "kg/m3"),
    ("recycled_content_pct", "Gerecycled gehalte", "Recycled content", "numeric", "%"),
    ("nrc", "NRC", "Noise Reduction Coefficient", "numeric", None),
    ("uniform_load", "Gelijkmatige belasting", "Uniform load", "numeric", "kPa"),
    ("max_service_temperature", "Maximale gebruikstemperatuur", "Maximum service temperature", "numeric", "°C"),
    ("ce_marked", "CE-gemarkeerd", "CE marked", "boolean", None),
]


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame(ROWS, SPECS)


def run(spark, specs, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return {(r.answer_claim_id, r.field_name): r.value_milli for r in values_to_convert(spark.createDataFrame(full, CLAIMS), specs).collect()}


@pytest.mark.parametrize(
    "text,lang,value",
    [("1.234,5", "nl", 1234.5), ("1,234.5", "en", 1234.5), ("1 234,5", "fr", 1234.5), ("1.234", "nl", 1234), ("1.234", "en", 1.234), ("1,234", "en", 1234), ("1,234", "fr", 1.234), ("2 1/4", "en", 2.25), ("3/8", "nl", 0.375), ("0,388", "nl", 0.388), ("12", "nl", 12), ("1.234.567", "nl", 1234567), ("98,625", "nl", 98.625), ("", "nl", None)],
)
def test_number(spark, text, lang, value):
    assert spark.range(1).select(number(F.lit(text), F.lit(lang)).alias("v")).first().v == value


def test_keys(spark, specs):
    entered = ["thickness_mm", "Thickness (mm)", "DIKTE", "Thicknes", "thk.", "paneeldikte:", "price", "Density", None, ""]
    got = {r.entered: r.spec_key for r in resolve_spec_keys(spark.createDataFrame([(e,) for e in entered], "entered string"), specs).collect()}
    assert [got.get(e) for e in entered] == ["thickness_mm"] * 6 + [None, "density", None, None]


def test_conversion(spark, specs):
    got = run(spark, specs, [
        ("Acme 60", "Dikte", 2.25, None, None, "inches", "De Acme 60 heeft een dikte van 2 1/4 inches."),
        ("Acme 60", "thickness_mm", 57.15, None, None, "mm", "De Acme 60 heeft een dikte van 2 1/4 inches."),
        ("Acme 60", "thickness_mm", 37.0, None, None, None, "Acme 60: dikte 37 MM."),
        ("Acme 60", "thickness_mm", 0.36, None, None, "mm", "At 0.36 mtr the thickness of the Acme 60 is more than enough."),
        ("Acme 60", "recycled_content_pct", 0.14, None, None, None, "Acme 60: gerecycled gehalte 0,14."),
        ("Acme 60", "nrc", 97.0, None, None, None, "Selon le fabricant la NRC du Acme 60 vaut 97 pct."),
        ("Acme 60", "uniform_load", 1.5, 2.0, None, None, "At 1.5 to 2 kN/m² the uniform load of the Acme 60 is more than enough."),
        ("Acme 60", "max_service_temperature", None, None, "401,2 K", None, "Voor de Acme 60 geldt een gebruikstemperatuur van 401,2 K."),
        ("Acme 60", "density", 1.264, None, None, None, "Acme 60: dichtheid 1,264 t/m3."),
        ("Acme 60", "thickness_mm", 3.0, None, None, "cm", "De Acme 60 heeft een dikte van 3 cm (gemeten bij 334 mm afhanghoogte)."),
        ("Acme 60", "ce_marked", 3.0, None, None, "cm", "3 cm"),
        ("Acme 60", "price", 3.0, None, None, "cm", "3 cm"),
        ("Acme 60", "thickness_mm", 3.0, None, None, "dB", "De Acme 60 heeft een dikte van 3 dB."),
    ])
    v = "value_numeric"
    assert got == {(0, v): 57150, (3, v): 360000, (4, v): 14000, (5, v): 970, (6, v): 1500, (6, "value_numeric_max"): 2000, (7, v): 128050, (8, v): 1264000, (9, v): 30000}


def test_common_unit_in_text_is_no_case(spark, specs):
    got = run(spark, specs, [
        ("Acme 60", "thickness_mm", None, None, "2693 MM", None, "Acme 60: dikte 2693 MM."),
        ("Acme 60", "recycled_content_pct", None, None, "82 %", None, "Acme 60: gerecycled gehalte 82 %."),
        ("Acme 60", "recycled_content_pct", None, None, "0,82", None, "Acme 60: gerecycled gehalte 0,82."),
        ("Acme 60", "uniform_load", None, None, "2 kN/m2", None, "Acme 60: belasting 2 kN/m2."),
        ("Acme 60", "thickness_mm", None, None, "3 cm", "mm", None),
    ])
    v = "value_numeric"
    assert got == {(2, v): 82000, (3, v): 2000, (4, v): 30000}


def test_long_vocabulary_is_joined_without_a_broadcast(spark, specs, monkeypatch):
    from citebase import session
    from citebase.operators import units, vocabulary

    rows = [("Acme 60", "Thicknes", 3.0, None, None, "cm", "3 cm"), ("Acme 60", "thickness_mm", 3.0, None, None, "cm", "3 cm"), ("Acme 60", "price", 3.0, None, None, "cm", "3 cm")]
    whole = run(spark, specs, rows)
    for m in (units, vocabulary):
        monkeypatch.setattr(m, "small", lambda df: session.small(df, 0))
    assert run(spark, specs, rows) == whole == {(0, "value_numeric"): 30000, (1, "value_numeric"): 30000}


def test_edges(spark, specs):
    empty = spark.createDataFrame([], CLAIMS)
    assert values_to_convert(empty, specs).count() == 0
    assert values_to_convert(empty, spark.createDataFrame([], SPECS)).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, None, "nrc", 1.0, None, None, None, None), (3, "x", "nrc", 1.0, 2.0, None, None, "")], CLAIMS)
    assert convert_claims(nulls, specs).where("status = 'convert'").count() == 0
    row = (7, "Acme 60", "thickness_mm", 3.0, None, None, "cm", "De Acme 60 heeft een dikte van 3 cm. " + "Tekst zonder maat. " * 5000)
    twice = spark.createDataFrame([row, row], CLAIMS).withColumns({c: F.lit(1) for c in ("key", "q", "factor", "lang", "unit_id", "resolved", "entered", "alias")})
    assert [r.value_milli for r in values_to_convert(twice, specs.withColumn("factor", F.lit(3))).collect()] == [30000, 30000]


FRAMES = {
    "nl": ["De {p} heeft een dikte van {v}.", "Volgens de fabrikant haalt de {p} een dikte van {v}.", "{p}: dikte {v}."],
    "en": ["The {p} has a thickness of {v}.", "At {v} the thickness of the {p} is more than enough.", "{p}: thickness {v}."],
    "de": ["Mit {v} reicht die Dicke der {p} völlig aus.", "Laut Hersteller ist die Dicke der {p} mit {v} angegeben."],
    "fr": ["Avec {v}, la épaisseur du {p} suffit largement.", "Selon le fabricant la épaisseur du {p} vaut {v}."],
}


def written(x, lang, grouped):
    """A number as a language writes it, thousands grouped or not."""
    whole, _, rest = f"{x:.3f}".rstrip("0").rstrip(".").partition(".")
    if grouped and len(whole) > 3:
        whole = whole[:-3] + {"nl": ".", "de": ".", "en": ",", "fr": " "}[lang] + whole[-3:]
    return whole + ((("." if lang == "en" else ",") + rest) if rest else "")


def test_made_claims_come_out_as_made(spark, specs):
    """Claims written from known values in every language, unit and number form, against their own truth."""
    import random

    from citebase.operators.units import UNITS

    r, rows, want = random.Random(11), [], {}
    length = [(u, f, names) for u, q, f, _, names in UNITS if q == "length"]
    for i in range(600):
        lang = r.choice(list(FRAMES))
        unit, factor, names = r.choice(length)
        x = r.choice([r.randint(1, 900), round(r.uniform(0.05, 99), 2), r.randint(1000, 9999), round(r.uniform(1, 9), 3)])
        stated = written(x, lang, r.random() < 0.7) + r.choice([" ", "", " "]) + r.choice(names)
        quote = r.choice(FRAMES[lang]).format(p="Acme Mono 60", v=stated)
        if r.random() < 0.2:
            quote = quote[:-1] + " (gemeten bij 334 mm afhanghoogte)."
        kind = r.choice(["stated", "stated", "converted", "text"])
        number = {"stated": float(x), "converted": round(x * factor, 6), "text": None}[kind]
        rows.append(("Acme Mono 60", "thickness_mm", number, None, stated if kind == "text" else None, r.choice([None, "mm", unit]) if kind != "text" else None, quote))
        if unit != "mm" and kind != "converted":
            want[i, "value_numeric"] = round(round(x * factor * 1000, 5))
    got = run(spark, specs, rows)
    wrong = {k: (rows[k[0]], got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert not wrong, list(wrong.values())[:5]
