import random

from pyspark.sql import functions as F

from citebase.llm import listings as g

SCHEMA = "listing_id bigint, run_id string, seller string, brand_name string, product_name string, spec_text string, manufacturer_ref string"


def test_parse():
    p = lambda *a: g.parse(*a)[:8]
    assert p("Noramardo NV", "TOP Nekelrislum-508", "dikte 12 mm\ncolour: zwart\n600X1200 MM\nkant E15", "NEK-508") == ("noramardo", "nekelrislum", "508", "600x1200", 12, "e15", "black", "nek-508")
    assert p(None, "Pafarkabru675 | 1,2*0,6 m | bord SL2", 'thk 0.98"; colour: grau', "ART12") == (None, "pafarkabru", "675", "600x1200", 25, "sl2", "grey", None)
    assert p("A", "Wotimardo 568 - 300 mm breed, 1500 mm lang - edge A-24", "<b>Specs</b> d=4 cm / eiken", None)[3:7] == ("300x1500", 40, "a24", "oak")
    assert p("A", "Ratorlourd 392, L 2400 mm B 600 mm, rand d2, Dicke 0,015 m", "weiß", None)[3:7] == ("600x2400", 15, "d2", "white")
    assert p(None, None, None, None) == (None,) * 8


def test_em_separates():
    n, full = g.FIELDS, (2,) * 8
    at = lambda **k: tuple(k.get(f, 2) for f in n)
    patterns = [(full, 100), (at(brand=1), 40), (at(size=0), 300), (at(colour=0, ref=1), 300), (at(series=3, ref=1), 5), (at(size=0, edge=0, colour=0), 90)]
    w = g.fit_weights(patterns, {c: 0.2 for c in g.STRICT})
    assert w[full] > 0.99 and w[at(brand=1)] > 0.9 and w[at(series=3, ref=1)] > 0.5 and max(w[at(size=0)], w[at(colour=0, ref=1)], w[at(size=0, edge=0, colour=0)]) < 0.01
    assert g.fit_weights([], {}) == {}


def test_chance_agreement(spark):
    reps = spark.createDataFrame([(3, "a", "50", "1x1", 12, None, None), (1, "b", "50", "1x1", 20, None, "red")], "n bigint, brand string, number string, size string, thickness int, edge string, colour string")
    assert g.chance_agreement(reps) == {"brand": 12.5 / 54, "size": 14 / 54, "thickness": 12.5 / 54, "colour": 11 / 51}


def test_the_threshold_decides(spark, monkeypatch):
    """Two usual spellings one edit apart: alike in all else they are linked, but not by a threshold near 1."""
    spec = "600x600 mm, d=12 mm, kant A15, wit"
    rows = [(i, "Acme", "Nekelrislum 508", spec) for i in range(1, 4)] + [(i, "Acme", "Nekelrislam 508", spec) for i in range(4, 6)] + [(6, "Acme", "Nekelrisla 508", spec)]
    found = pairs_of(spark, rows)
    assert found == {(a, b) for a in range(1, 7) for b in range(1, 7) if a < b}
    monkeypatch.setattr(g, "LINK", 1 - 1e-12)
    assert pairs_of(spark, rows) == {(1, 2), (1, 3), (2, 3), (4, 5)}
    apart = [(1, "Acme", "Nekelrislum 508", spec), (2, "Acme", "Nekelrislum 508", spec.replace("12", "15")), (3, "Acme", "Nekelrislum 508", spec.replace("wit", "zwart"))]
    monkeypatch.setattr(g, "LINK", 0.5)
    assert pairs_of(spark, apart) == set()
    monkeypatch.setattr(g, "LINK", 0.0)
    assert len(pairs_of(spark, apart)) >= 2


def listing(i, brand, series, number, size, thick, edge, colour, r):
    name = f"{r.choice(['promo ', ''])}{brand if r.random() < 0.6 else ''} {r.choice([series, series.upper()])}{r.choice(['-', ' ', ''])}{number} plafondplaat"
    specs = [r.choice([f"{size[0]}x{size[1]} mm", f"{size[1] / 10:g} x {size[0] / 10:g} cm"]), r.choice([f"dikte {thick} mm", f"d={thick / 10:g} cm"]), r.choice([f"kant {edge}", f"edge {edge.lower()}"]), r.choice({"white": ["wit", "blanc"], "oak": ["eiken", "chêne"]}[colour])]
    r.shuffle(specs)
    return (i, "r", "s", r.choice([brand, brand.upper() + " GmbH"]), name, " / ".join(specs), None)


def test_groups_against_truth(spark):
    r, rows, truth = random.Random(5), [], {}
    kinds = [(b, s, n, size, t, e, c) for b, s, n in (("Noravell", "Nekelrislum", 508), ("Brinplon", "Gebinosaro", 508), ("Noravell", "Tadunkafos", 731)) for size in ((600, 600), (600, 1200)) for t in (12, 20) for e, c in (("E15", "white"), ("SL2", "oak"))]
    for i in range(300):
        k = kinds[0] if i % 3 == 0 else r.choice(kinds)  # one product holds a third
        series = k[1] if r.random() < 0.85 else k[1][:4] + k[1][5:]
        rows.append(listing(i, k[0], series, *k[2:], r))
        truth.setdefault(k, []).append(i)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("brand", "size", "series", "ref", "rest", "component", "n")})
    groups = g.group_listings(df)
    got = {tuple(x) for x in g.same_product_pairs(groups).collect()}
    want = {(a, b) for ids in truth.values() for a in ids for b in ids if a < b}
    assert got == want
    assert groups.count() == 300 and groups.where("links = 0").count() == sum(len(v) == 1 for v in truth.values())


def pairs_of(spark, rows):
    df = spark.createDataFrame([(i, "r", "s", brand, name, spec, None) for i, brand, name, spec in rows], SCHEMA)
    return {tuple(x) for x in g.same_product_pairs(g.group_listings(df)).collect()}


def test_two_brands_of_one_series_and_number(spark):
    spec = "600x600 mm, d=12 mm, kant A15, wit"
    rows = [(i, "Acme", "Nekelrislum 508", spec) for i in range(1, 6)] + [(6, "Acme", "Nekelrislm 508", spec)]
    rows += [(7, "Brinplon", "Nekelrislum 508", spec), (8, "Brinplon", "Nekelrisluma 508", spec), (9, "Brinplon", "Nekelrslum 508", spec)]
    assert pairs_of(spark, rows) == {(a, b) for ids in (range(1, 7), range(7, 10)) for a in ids for b in ids if a < b}


def test_open_attribute(spark):
    hub = [(i, "Acme", "Nekelrislum 508", "600x600 mm, d=12 mm, kant A15, wit") for i in range(1, 6)]
    rows = [*hub, (6, "Acme", "Nekelrislum 508", "600x1200 mm, d=20 mm, kant A15, zwart"), (7, "Acme", "Nekelrislum 508", "600x1200 mm, d=20 mm, kant A15, mauve")]
    first = {(a, b) for a in range(1, 6) for b in range(1, 6) if a < b}
    assert pairs_of(spark, rows) == first | {(6, 7)}
    # one that fits two products joins neither and does not bridge them
    assert pairs_of(spark, [*rows, (8, "Acme", "Nekelrislum 508", "600x1200 mm, d=20 mm, kant A15, groen")]) == first


def test_agreeing_pairs_connect_what_all_pairs_connect(spark):
    r = random.Random(3)
    spell = ["abcdefgh", "abcdefg", "bcdefgh", "abcdefgi", "abcdfgh", "xbcdefgh"]
    rows = {tuple(r.choice(x) for x in (["p", "q", None], spell, ["50"], ["1x1", "1x2", None], [12], ["a1", None], ["red", "blue", None])) for _ in range(150)}
    rows = [(i, r.randint(1, 9), r.choice([None, "x-1", "y-2"]), *x) for i, x in enumerate(sorted(rows, key=str))]
    reps = spark.createDataFrame(rows, "id bigint, n bigint, ref string, brand string, series string, number string, size string, thickness int, edge string, colour string")
    usual = reps.join(g.usual_series(reps), ["number", "series"], "left")
    pairs, judged = g.agreeing_pairs(usual)
    got = {tuple(x) for x in pairs.collect()}
    spelled, known = {x.id: x.usual for x in usual.collect()}, {x.id: x for x in reps.collect()}
    bonds = {(x.series, x.other) for x in g.close_series(usual).collect()}
    fits = lambda a, b: all(a[c] is None or b[c] is None or a[c] == b[c] for c in g.STRICT) and (spelled[a.id] == spelled[b.id] or (a.series, b.series) in bonds)
    partners = {i: [b for b in known.values() if b.id != i and fits(a, b)] for i, a in known.items()}
    unclear = {i: {c for c in g.OPEN if a[c] is None and len({b[c] for b in partners[i]} - {None}) > 1} for i, a in known.items()}
    assert {x.id: {c for k, c in enumerate(g.OPEN) if x.unclear >> k & 1} for x in judged.collect()} == unclear
    joins = lambda i, b: all(b[c] is None for c in unclear[i])
    want = {(i, b.id) for i in known for b in partners[i] if i < b.id and joins(i, b) and joins(b.id, known[i])}

    def parts(edges):
        label = dict.fromkeys(known)
        for i in known:
            todo = [i]
            while todo:
                x = todo.pop()
                if label[x] is None:
                    label[x] = i
                    todo += [b for e in edges if x in e for b in e]
        return label

    assert got <= want and parts(got) == parts(want)


def test_edges(spark):
    rows = [(1, None, None, None, None, None, None), (2, "r", None, None, "", "", None), (3, "r", "s", "Acme", "Nekelrislum 508 600x600 mm", "d=12 mm, kant A15, wit", None), (3, "r", "s", "Acme", "Nekelrislum 508 600x600 mm", "d=12 mm, kant A15, wit", None)]
    runs = spark.createDataFrame([("r", [("Nekelrislum 508 600x600 mm", "x", 3, 0.5)]), ("q", None)], "run_id string, possible_duplicate_products array<struct<new_name:string,existing_name:string,existing_id:bigint,similarity:double>>")
    got = g.group_listings(spark.createDataFrame(rows, SCHEMA), runs)
    assert {r.listing_id for r in got.collect()} == {1, 2, 3} and g.same_product_pairs(got).count() == 0
    assert g.group_listings(spark.createDataFrame([], SCHEMA), runs.limit(0)).count() == 0


def test_components(spark):
    nodes = spark.range(1, 60).select(F.col("id"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50)], "a bigint, b bigint")
    got = {r.id: r.component for r in g.components(nodes, edges).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[41] == 40 and got[35] == 35
