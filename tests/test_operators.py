"""Golden cases of the operators, and their edges."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from citebase.functions import numbers, similarity, text, vectors, web as urls
from citebase.operators import audit, chunking, facts, relational, retrieval, security, web


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_similarity(spark):
    s = lambda a, b: one(spark, similarity.similarity(F.lit(a), F.lit(b)))
    assert round(s("word", "two words"), 4) == 0.3636
    assert s("abc", "abc") == 1.0 and s("", "") is None and s("a", "zzz") == 0.0


def test_scalars(spark):
    assert one(spark, text.normalize(F.lit("A  b–C "))) == "a b-c"
    assert one(spark, text.normalize_full(F.lit("Straße  ﬁn"))) == "strasse fin"
    assert one(spark, text.slug(F.lit("Café  Déjà-vu!"))) == "cafe-deja-vu"
    assert one(spark, text.slug(F.lit("!!!"))) == "product"
    assert one(spark, text.mention_offset(F.lit("wij kiezen ACME of Rival"), ["rival", " acme ", ""])) == 11
    assert one(spark, text.mention_offset(F.lit("x"), [])) is None
    assert [one(spark, numbers.six_digits(F.lit(v))) for v in (0.85, 1234.5, 100.0, 0.0)] == ["0.85", "1234.5", "100", "0"]
    assert one(spark, numbers.digits_within(F.lit(6.0), F.lit("EI 60")))
    assert not one(spark, numbers.digits_within(F.lit(7.0), F.lit("EI 60")))
    assert one(spark, numbers.to_number(F.lit("abc"))) is None
    assert abs(one(spark, vectors.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) - 1) < 1e-12
    assert one(spark, vectors.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None
    assert one(spark, text.own_brand(F.lit("Acme Architectural"), "Acme")) and not one(spark, text.own_brand(F.lit(None), "Acme"))


@pytest.mark.parametrize("href,url", [("/a?x=1#y", "https://h.example/a"), ("b", "https://h.example/p/b"), ("https://o.example/c#d", "https://o.example/c"), ("mailto:x@y", None), ("#top", None), ("//cdn.example/z", "https://cdn.example/z"), ("../x", "https://h.example/x"), ("./r", "https://h.example/p/r"), ("../../../y", "https://h.example/y"), ("s/./t/../u/", "https://h.example/p/s/u/"), ("..", "https://h.example/"), (".", "https://h.example/p/"), ("/a//b/../c", "https://h.example/a/c"), ("?q=1", "https://h.example/p/q"), ("", None), ("https://o.example/a/../b", "https://o.example/a/../b")])
def test_resolve(spark, href, url):
    assert one(spark, urls.resolve(F.lit("https://h.example/p/q"), F.lit(href))) == url


LOG = "id bigint, k string, at bigint, v double"


def test_chain_with_and_without_slices(spark):
    rows = [(1, "a", 1, 1.0), (2, "a", 2, 1.0), (3, "a", 3, 2.0), (4, "b", 1, None), (5, "b", 9, None), (6, None, 1, 5.0), (7, "a", 25, 2.0)]
    log = spark.createDataFrame(rows, LOG)
    a = relational.supersede_chain(log, ["k"], ["at", "id"], "id", ["v"]).toPandas()
    b = relational.supersede_chain(log, ["k"], ["at", "id"], "id", ["v"], slices=F.floor(F.col("at") / 2)).toPandas()
    pd.testing.assert_frame_equal(a.sort_values("id").reset_index(drop=True), b.sort_values("id").reset_index(drop=True))
    got = a.set_index("id")
    assert got["superseded_by"].fillna(0).astype(int).to_dict() == {1: 2, 2: 3, 3: 7, 4: 5, 5: 0, 6: 0, 7: 0}
    assert got["is_change"].to_dict() == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False}
    acts = facts.persist_claims(log, ["k"], ["at", "id"], "id", ["v"]).toPandas().set_index("id")["action"].to_dict()
    assert acts == {1: "insert", 2: "no-op", 3: "supersede", 4: "insert", 5: "no-op", 6: "insert", 7: "no-op"}


def test_sums_and_as_of_with_slices(spark):
    log = spark.createDataFrame([(i, "k" if i % 3 else "x", i, float(i)) for i in range(40)], LOG)
    for slices in (None, F.floor(F.col("at") / 7)):
        s = relational.running_sum(log, ["k"], ["at"], F.col("v"), "s", slices).toPandas()
        want = s.sort_values("at").groupby("k")["v"].cumsum()
        assert (s.sort_values("at")["s"] == want).all()
        right = log.where("id % 5 = 0").select("k", "at", F.col("v").alias("w"))
        r = relational.as_of(log.select("id", "k", "at"), right, "k", "at", ["w"], slices).toPandas().set_index("id")["right_w"]
        for i in range(40):
            known = [j for j in range(0, i + 1, 5) if bool(j % 3) == bool(i % 3)]
            assert (r[i] != r[i]) if not known else r[i] == max(known)


def test_latest_insert_upsert_orphans(spark):
    log = spark.createDataFrame([(1, "a", 1, 1.0), (2, "a", 2, 70.0), (3, "b", 1, 5.0), (4, None, 1, 5.0)], LOG)
    assert {r.id for r in relational.latest_per_key(log, ["k"], ["at", "id"]).collect()} == {2, 3, 4}
    new = spark.createDataFrame([(9, "a", 0, 0.0), (8, "c", 0, 0.0), (7, "c", 0, 0.0)], LOG)
    assert {r.id for r in relational.insert_if_absent(log, new, ["k"]).collect()} == {7}
    assert {r.id for r in relational.upsert(log, new.where("id > 7"), ["k"]).collect()} == {3, 4, 8, 9}
    assert {(r.k, r.promoted) for r in relational.orphan_keys(log, ["k"], F.col("v") > 60, ["at", "id"], "id").collect()} == {("b", 3), (None, 4)}
    assert relational.latest_per_key(log.limit(0), ["k"], ["at"]).count() == 0


def test_tree_and_graph(spark):
    tree = spark.createDataFrame([("a", "b", "A"), ("b", "c", "B"), ("c", None, "C"), ("x", "y", "X"), ("l", "l", "L")], "id string, parent_id string, code string")
    got = {r.id: (r.path, r.is_cycle) for r in relational.ancestors(tree).collect()}
    assert got == {"a": (["A", "B", "C"], False), "b": (["B", "C"], False), "c": (["C"], False), "x": (["X"], False), "l": (["L"], True)}
    ring = spark.createDataFrame([("p", "q", "P"), ("q", "r", "Q"), ("r", "p", "R"), ("s", "p", "S")], "id string, parent_id string, code string")
    assert {r.id: ("".join(r.path), r.is_cycle) for r in relational.ancestors(ring).collect()} == {"p": ("PQR", True), "q": ("QRP", True), "r": ("RPQ", True), "s": ("SPQR", True)}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "a int, b int")
    assert {(r.node, r.hop) for r in relational.reachable(e, spark.createDataFrame([(1,)], "node int"), 9).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_rates(spark):
    rows = spark.createDataFrame([("x", True), ("x", False), (None, True)], "g string, hit boolean")
    assert {(r.g, r.hits, r.total, r.rate) for r in relational.rates_by(rows, "g", F.col("hit")).collect()} == {("x", 1, 2, 0.5), ("unknown", 1, 1, 1.0), ("overall", 2, 3, 0.666667)}
    assert [(r.g, r.total, r.rate) for r in relational.rates_by(rows.limit(0), "g", F.col("hit")).collect()] == [("overall", 0, None)]


def test_share_of_voice_and_accuracy(spark):
    schema = "claim_id bigint, answer_id string, g string, brand_name string, is_competitor boolean, verdict string"
    c = spark.createDataFrame([(1, "a1", "i", "Acme", False, "correct"), (2, "a1", "i", "acme ", False, "incorrect"), (3, "a1", "i", "Rival", True, "incorrect"), (4, "a2", "i", "Rival", True, "correct"), (5, "a2", "i", "Acme", None, "unverifiable_spec")], schema)
    overall = lambda df: {r.g: r.rate for r in df.collect()}["overall"]
    assert overall(audit.share_of_voice(c.where("claim_id < 5"), "g")) == round(1 / 3, 6)
    assert overall(audit.spec_accuracy(c, "g")) == 0.5
    assert overall(audit.spec_accuracy(c.limit(0), "g")) is None
    picture = {r.brand_key: (r.mentions, r.correct, r.incorrect, r.unverifiable) for r in audit.competitive_picture(c, "g", "Acme").collect()}
    assert picture == {"acme": (2, 1, 1, 1), "rival": (2, 1, 1, 0)}


def test_coverage(spark):
    p = spark.createDataFrame([("p1", "a"), ("p2", None)], "product_id string, category_code string")
    a = spark.createDataFrame([("s1", []), ("s2", ["a"]), ("s3", ["b"])], "spec_key string, category_codes array<string>")
    f = spark.createDataFrame([("p1", "s2", "stated"), ("p1", "s1", "not_stated")], "product_id string, spec_key string, presence string")
    got = {r.product_id: (r.stated, r.missing, r.completeness) for r in audit.coverage(p, a, f).collect()}
    assert got == {"p1": (["s2"], ["s1"], 0.5), "p2": ([], ["s1"], 0.0)}
    none = {r.product_id: r.completeness for r in audit.coverage(p, a.limit(0), f).collect()}
    assert none == {"p1": 0.0, "p2": 0.0}


VALUES = "claim_id string, product_id string, spec_key string, value_numeric double, value_numeric_max double, value_text string, value_bool boolean, value_enum string"


def test_verdicts(spark):
    attributes = spark.createDataFrame([("alpha", "numeric", 0.05, ["ghost", "nrc"]), ("nrc", "numeric", 0.05, ["alpha"]), ("class", "enum", None, None)], "spec_key string, data_type string, comparison_tolerance double, confusable_with array<string>")
    truth = spark.createDataFrame([("p", "alpha", "stated", 0.7, 0.0, None, None, None), ("p", "nrc", "stated", 0.9, None, None, None, None), ("p", "class", "not_stated", None, None, None, None, None)], "product_id string, spec_key string, presence string, value_numeric double, value_numeric_max double, value_text string, value_bool boolean, value_enum string")
    c = lambda i, key, v, p="p": (i, p, key, v, None, None, None, None)
    claims = spark.createDataFrame([c("1", "alpha", 0.72), c("2", "alpha", 0.5), c("3", "alpha", 0.9), c("4", "class", None), c("5", "alpha", 0.7, None), c("6", "other", 1.0)], VALUES)
    got = {r.claim_id: (r.verdict, r.confusable_key) for r in facts.diff_claims(claims, attributes, truth).collect()}
    assert got == {"1": ("correct", None), "2": ("incorrect", None), "3": ("likely_confusion", "nrc"), "4": ("unverifiable_spec", None), "5": ("unverifiable_product", None), "6": ("unverifiable_spec", None)}


def test_verify(spark):
    schema = "id int, spec_key string, presence string, source_snippet string, page_number int, page_text string, value_numeric double, value_numeric_max double, value_text string, value_bool boolean, value_enum string, unit string, target_unit string, derivation_note string"
    q = "Brandwerendheid EI 60 volgens NEN"
    row = lambda i, **k: tuple({**dict(id=i, spec_key="ei", presence="stated", source_snippet=q, page_number=1, page_text=f"Technisch\n{q}\n", value_numeric=60.0, value_numeric_max=None, value_text=None, value_bool=None, value_enum=None, unit="min", target_unit="min", derivation_note="n"), **k}.values())
    rows = [row(1), row(2, page_text="nothing here"), row(3, presence="not_stated", source_snippet=None), row(4, page_number=None), row(5, page_text=None), row(6, value_text="x"), row(7, value_numeric=75.0), row(8, presence="derived", value_numeric=75.0), row(9, value_numeric=6.0, unit="cm", target_unit="mm"), row(10, spec_key="low"), row(11, value_numeric_max=90.0)]
    got = {r.id: r for r in facts.verify_claims(spark.createDataFrame(rows, schema), spark.createDataFrame([("low", 0.0, 5.0)], "spec_key string, low double, high double")).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "not verbatim", 3: None, 4: "no citation", 5: "no page text", 6: "not one value", 7: "digits not in quote", 8: None, 9: None, 10: "implausible", 11: "upper digits not in quote"}
    assert got[3].value_numeric is None and got[9].value_numeric == 60.0 and got[9].unit == "mm"
    assert got[1].derivation_note is None and got[8].derivation_note == "n"


def test_similar_pairs_equal_brute_force(spark):
    names = [f"{a} {b} {n}" for a in ("Gadorgodal", "Gadorgodel", "Fabinsovix") for b in ("Mono", "Fire") for n in (10, 20)] + ["", None, "x"]
    df = spark.createDataFrame([(i, n, "g" if i % 2 else None) for i, n in enumerate(names)], "id int, name string, b string")
    got = {(r.id_a, r.id_b) for r in facts.similar_pairs(df, ["b"]).collect()}
    grams = {i: {f"  {w} "[k : k + 3] for w in (n or "").lower().split() for k in range(len(w) + 1)} for i, n in enumerate(names)}
    want = {(i, j) for i in grams for j in grams if i < j and i % 2 == j % 2 and grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.35}
    assert got == want


def test_best_match(spark):
    e = spark.createDataFrame([("acme gmbh",), ("zzz",), (None,), ("acme gmbh",)], "entered string")
    n = spark.createDataFrame([("Acme",), ("Acne",), (None,)], "name string")
    assert {(r.entered, r.name) for r in facts.best_match(e, n).collect()} == {("acme gmbh", "Acme"), ("zzz", None)}


def test_text_query(spark):
    m = lambda q, t: one(spark, retrieval.TextQuery.of(q).matches(text.words(F.lit(t))))
    assert m("een raster", "raster van een") and not m("een raster", "een")
    assert m('"in een"', "past in een raster") and not m('"een in"', "past in een raster")
    assert m("x or raster", "raster") and not m("raster -hout", "hout raster") and not m("", "raster")


def test_nearest_to_each(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0]), (103, [1.0, None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    for block in (2000, 3):
        got = retrieval.nearest_to_each(v, v.where("vec_id % 10 = 0 or vec_id > 99"), 4, block=block).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append(r.id)
        assert set(found) == {0, 10, 20, 30, 40, 50, 102}
        vec = {i: x for i, x in rows if i < 60}
        norm = lambda x: sum(c * c for c in x) ** 0.5
        for q, ids in found.items():
            if q < 60:
                want = sorted(vec, key=lambda i: (round(1 - sum(a * b for a, b in zip(vec[q], vec[i])) / norm(vec[q]) / norm(vec[i]), 10), i))[:4]
                assert ids == want
    assert retrieval.nearest_to_each(v, v.limit(0), 4).count() == 0 and retrieval.nearest_to_each(v.limit(0), v, 4).count() == 0


def test_search_pools_before_best(spark):
    chunks = spark.createDataFrame([(1, "p", [1.0, 0.0], "aap noot"), (2, "p", [1.0, 0.1], "aap"), (3, "q", [0.0, 1.0], "noot"), (4, "r", [1.0, 0.0], "mies")], "chunk_id bigint, product_id string, embedding array<float>, content string")
    kept = spark.createDataFrame([("p",), ("q",)], "product_id string")
    done = spark.createDataFrame([("p", 0.5)], "product_id string, completeness double")
    out = {r.product_id: r for r in retrieval.search_products(chunks, kept, done, [1.0, 0.0], "noot", pool=2).collect()}
    assert set(out) == {"p", "q"} and out["p"].vector_rank == 1 and out["q"].vector_rank is None and out["q"].keyword_rank == 1
    assert abs(out["p"].score - (1 / 61 + 1 / 62 + 0.002)) < 1e-9
    assert retrieval.search_products(chunks, kept, done, None, None).count() == 0


def test_value_visible(spark):
    rows = [(1, 0.85, None, None, "<p>Geluidsabsorptie: 0,85</p>"), (2, 85.0, None, None, "<p>850 mm</p>"), (3, None, "Wit", None, "<b>wit</b>"), (4, None, None, True, "ja"), (5, 5.0, None, None, "<script>5</script>x"), (6, 106.0, None, None, "106µg")]
    got = {r.id: r.found for r in web.value_visible(spark.createDataFrame(rows, "id int, value_numeric double, value_text string, value_bool boolean, html string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: None, 5: False, 6: False}


PAGES = "page_id bigint, document_version_id bigint, page_number int, median_font_size double, page_lines array<struct<text:string,top:double,avg_font_size:double>>, page_tables array<struct<rows:array<array<string>>,top:double,bottom:double>>"


def test_chunking(spark):
    line = lambda t, top, size=10.0: (t, float(top), size)
    pages = spark.createDataFrame([
        (1, 1, 1, 10.0, [line("Kop", 0, 16.0), line("Onderkop", 10, 13.0), line("lopende tekst", 20), line("in tabel", 45), line("ook", 55), line("", 60)], [([["Spec", "Waarde"], ["Dikte", None], ["a|b"]], 40.0, 80.0)]),
        (2, 1, 2, 10.0, [line("slot", 5)], None),
        (3, 2, 1, 10.0, [line("woord", float(i)) for i in range(2000)], []),
        (4, 3, 1, None, None, None),
    ], PAGES)
    got = chunking.chunk_documents(pages).orderBy("document_version_id", "chunk_index").collect()
    first = [r for r in got if r.document_version_id == 1]
    assert [r.chunk_type for r in first] == ["prose", "table", "prose"]
    assert first[0].content == "Kop > Onderkop\n\nlopende tekst" and first[0].heading_path == ["Kop", "Onderkop"]
    assert first[1].content.endswith("| Spec | Waarde |\n| --- | --- |\n| Dikte |  |\n| a/b |  |")
    assert first[2].content == "Kop > Onderkop\n\nlopende tekst slot" and (first[2].page_start, first[2].page_end) == (1, 2)
    long = [r for r in got if r.document_version_id == 2]
    assert len(long) > 1 and all(r.token_count <= 800 for r in long) and sum(r.token_count for r in long) == 2000 + 120 * (len(long) - 1)


def test_group_lines(spark):
    w = spark.createDataFrame([(1, "b", 10.5, 5.0, 9.0), (1, "a", 10.0, 1.0, 11.0), (1, "c", 20.0, 1.0, 10.0)], "page_id int, text string, top double, left double, size double")
    assert [(r.text, r.median_size) for r in chunking.group_lines(w, ["page_id"]).orderBy("line").collect()] == [("a b", 11.0), ("c", 10.0)]


def test_secured(spark):
    rows = spark.createDataFrame([(1, "o1", False), (2, "o2", True), (3, None, None), (4, "o2", False)], "id int, owner string, pub boolean")
    m = spark.createDataFrame([("me", "o1"), ("me", "o1"), ("you", "o2")], "principal string, owner string")
    ids = lambda **k: {r.id for r in security.secured(rows, "owner", m, "me", **k).collect()}
    assert ids() == {1} and ids(published="pub") == {1, 2} and ids(staff=True) == {1, 2, 3, 4}


def test_tasks_and_statement(spark):
    b = spark.createDataFrame([("x", 5), ("y", 1)], "task string, n int")
    got = [(r.task, r.impact) for r in audit.ranked_tasks([(b, 1), (b, 3)]).collect()]
    assert got == [("x", 3), ("y", 1), ("x", 3), ("y", 1)]
    counts = spark.createDataFrame([("acme", 2), ("rival", 3)], "brand string, mentions int")
    assert audit.problem_statement(counts, "acme").first().statement == "rival is named more often than acme"
    assert audit.problem_statement(counts.limit(0), "acme").first().statement == "no brand is named"


def test_violations(spark):
    rows = spark.createDataFrame([(1, 1.0, None, None, None, None, None, "q", "p"), (2, 2.0, 1.0, "t", None, None, "mm", " ", None)], "id int, value_numeric double, value_numeric_max double, value_text string, value_bool boolean, value_enum string, unit string, source_quote string, product_name string")
    assert {(r.id, r.constraint) for r in facts.violations(rows, "id").collect()} == {(2, "one value"), (2, "range order"), (2, "quote given"), (2, "product given")}


def test_citations(spark):
    a = spark.createDataFrame([(1, ["https://www.acme.example/a", "https://www.acme.example/a"]), (2, ["https://x.example/b"]), (3, []), (4, None)], "answer_id int, citations array<string>")
    assert {(r.domain, r.citations, r.answers) for r in audit.citation_domains(a).collect()} == {("acme.example", 2, 1), ("x.example", 1, 1)}
    assert {r.answer_id: r.bucket for r in audit.citation_buckets(a, "acme.example").collect()} == {1: "own_site", 2: "third_party", 3: "no_citation", 4: "no_citation"}


def test_crawl(spark):
    page = lambda i, url, *hrefs: (i, url, "".join(f'<a href="{h}">x</a>' for h in hrefs))
    rows = [page(1, "https://a.example/nl", "nl/x", "/nl/y#p", "/en/z", "/nl/f.pdf"), page(2, "https://a.example/nl/x", "y?q=1", "/nl/gone"), page(3, "https://a.example/nl/y", "https://a.example/nl/x", "/nl/deep/er"), page(4, "https://a.example/nl/deep/er"), page(5, "https://a.example/en/z"), page(6, "https://a.example/nl/alone")]
    got = {r.url.split("example")[1]: r.hop for r in web.crawl(spark.createDataFrame(rows, "page_id int, url string, html string"), "https://a.example/nl").collect()}
    assert got == {"/nl": 0, "/nl/x": 1, "/nl/y": 1, "/nl/deep/er": 2}
    chain = [page(i, f"https://a.example/s/{i}/p", f"../{i + 1}/./p?x#y") for i in range(14)]  # deeper than ten links
    df = spark.createDataFrame(chain, "page_id int, url string, html string")
    assert sorted(r.hop for r in web.crawl(df, "https://a.example/s/0/p").collect()) == [0]  # the path of the start page bounds the crawl
    root = df.union(spark.createDataFrame([page(99, "https://a.example/s", "s/0/p")], df.schema))
    assert sorted(r.hop for r in web.crawl(root, "https://a.example/s").collect()) == list(range(15))
    assert [r.hop for r in web.crawl(root, "https://a.example/s", max_pages=3).collect()] == [0, 1, 2]


def test_skip_reasons(spark):
    rows = [(1, "https://a.example/nl/product/1", "t" * 300, "h1"), (2, "https://a.example/nl/product/2", "t", "h2"), (3, "https://a.example/nl/blog/3", "t" * 300, "h3"), (4, "https://a.example/nl/product/4", "t" * 300, "old"), (5, None, None, None)]
    got = {r.page_id: r.skip_reason for r in web.skip_reasons(spark.createDataFrame(rows, "page_id int, url string, text string, sha256 string"), "https://a.example/nl/", ["product"], spark.createDataFrame([("old",), (None,)], "sha256 string")).collect()}
    assert got == {1: None, 2: "too little text", 3: "no product page", 4: "unchanged", 5: "no product page"}


def test_notes(spark):
    c = spark.createDataFrame([(False, "correct"), (False, "unverifiable_spec"), (True, "incorrect")], "is_competitor boolean, verdict string")
    share = spark.createDataFrame([(0.1,)], "completeness double")
    assert [(r.position, r.figure) for r in audit.critical_notes(c, share).collect()] == [(1, 1.0), (2, 0.1), (3, 1.0)]
    assert [r.position for r in audit.critical_notes(c.limit(0), share.limit(0)).collect()] == [1]


def test_with_each(spark):
    few = spark.createDataFrame([("a", ["x"], {"k": 1}), ("b", None, None)], "n string, l array<string>, m map<string,int>")
    got = relational.with_each(spark.range(2), few).collect()
    assert {(r.id, r.n) for r in got} == {(0, "a"), (0, "b"), (1, "a"), (1, "b")} and [r.m for r in got if r.n == "a"] == [{"k": 1}] * 2
    assert relational.with_each(spark.range(2), few.limit(0)).count() == 0


def test_a_long_list_is_put_in_parts(spark, monkeypatch):
    monkeypatch.setattr(relational, "LIST_BOUND", 3)
    assert {(r.a, r.b) for r in relational.with_each(spark.range(4).toDF("a"), spark.range(8).toDF("b")).collect()} == {(a, b) for a in range(4) for b in range(8)}


def test_best_match_of_a_long_list(spark, monkeypatch):
    e, n = spark.createDataFrame([("acme gmbh",), ("zzz",)], "entered string"), spark.createDataFrame([("Acme",), ("Acne",), ("acmé",)], "name string")
    few = sorted(map(tuple, facts.best_match(e, n).collect()))
    monkeypatch.setattr(facts, "SMALL", 0)
    assert sorted(map(tuple, facts.best_match(e, n).collect())) == few


def test_sessions_across_slices(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 23, 40), dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 29), dt.datetime(2024, 1, 2, 1, 0), dt.datetime(2024, 1, 3), None]
    rows = spark.createDataFrame([("u", t) for t in at] + [("v", None)], "k string, at timestamp")
    got = relational.sessions(rows, "k", "at", "30 minutes", F.to_date("at")).collect()
    assert sorted((r.n, r.start.day, r.end.hour) for r in got) == [(1, 2, 1), (1, 3, 0), (3, 1, 0)]


def test_within_ceiling_ids_and_status(spark):
    rows = spark.createDataFrame([("r", 1, 4), ("r", 2, None), ("r", 3, 5), ("r", 4, 3), ("s", 1, 20)], "run string, i int, cost int")
    assert {(r.run, r.i, r.so_far) for r in relational.within_ceiling(rows, ["run"], ["i"], F.col("cost"), 10).collect()} == {("r", 1, 4), ("r", 2, 4), ("r", 3, 9)}
    ids = [r.id for r in relational.with_id(spark.createDataFrame([("a", None), ("a", None), ("a", "?"), (None, "a")], "x string, y string"), ["x", "y"]).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3
    docs = spark.createDataFrame([(1, "new", None, 3, None), (2, "new", "old", None, None), (3, "new", None, None, None)], "id int, status string, error string, pages int, parsed_at timestamp")
    ups = spark.createDataFrame([(1, "parsed", None, None), (2, "failed", None, 7), (2, "aborted", None, 1)], "id int, status string, error string, pages int")
    got = {r.id: (r.status, r.error, r.pages, r.parsed_at is not None) for r in relational.status_update(docs, ups, "id", F.current_timestamp(), {"parsed_at": "parsed"}, ["error", "pages"]).collect()}
    assert got == {1: ("parsed", None, 3, True), 2: ("failed", "old", 7, False), 3: ("new", None, None, False)}


PRODUCT = '{"@context": "x", "@graph": [{"@type": "Page"}, {"offers": {"@type": ["Thing", "Product"]}}]}'


@pytest.mark.parametrize(
    "html,want",
    [
        (f'<script type="application/ld+json">{PRODUCT}</script>', True), ("<SCRIPT id=a TYPE='application/ld+json'>{\"@type\": \"Product\"}</SCRIPT>", True), ('<script type="application/ld+json">{broken "Product"</script>', False),
        ('<script type="application/ld+json">{"@type": "Organization", "name": "Product"}</script>', False), ('<script>{"@type": "Product"}</script>', False), ('<div itemscope itemtype="https://schema.org/Product">x</div>', True), ('<div itemtype="https://schema.org/ProductGroup">x</div>', False),
        (f'<script type="application/ld+json">[1</script><script type="application/ld+json">[{PRODUCT}]</script>', True), (None, False), ("", False),
    ],
)
def test_structured_product(spark, html, want):
    df = spark.createDataFrame([(html,), (None,)], "html string")
    assert [r.s for r in df.select(web.structured_product(F.col("html")).alias("s")).collect()] == [want, False]


def test_page_visibility(spark):
    rows = [(1, "stated", 0.85, None, None, "waarde 0,85 dB", True), (1, "stated", 7.0, None, None, "70", True), (1, "not_stated", 0.85, None, None, "x", True), (1, "stated", None, None, True, "x", True), (2, None, None, "glas", None, "Glaswol", False)]
    got = web.page_visibility(spark.createDataFrame(rows, "page_id int, presence string, value_numeric double, value_text string, value_bool boolean, visible string, structured boolean"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1, 1, True), (2, 1, 0, 0, False)}


def test_median_of_a_cube(spark, tmp_path):
    import random
    from statistics import median

    from citebase.plans import catalogue

    r = random.Random(6)
    rows = [(r.choice("AB"), r.choice(["F", "O", None]), 1.5, r.choice([None, 900.0, 1000.25, 1000.75, 2500.5])) for _ in range(60)] + [("C", "F", 1.0, None)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(x) for x in catalogue.QUERIES["verdict_cube_median"](spark, str(tmp_path)).select("l_returnflag", "l_linestatus", "n", F.coalesce("median_price", F.lit(-1.0))).collect())
    groups = {}
    for a, b, _, x in rows:
        for key in ((3, a, b), (1, a, None), (2, None, b), (0, None, None)):
            groups.setdefault(key, []).append(x)
    want = sorted((a or "all", b or "all", len(v), round(median(w), 4) if (w := [x for x in v if x is not None]) else -1.0) for (_, a, b), v in groups.items())
    assert got == want


def test_six_digits_are_those_of_g(spark):
    import random

    r = random.Random(4)
    values = [0.0, 1e6, 999999.5, 999999.4, 1e-4, 9.9999999e-5, 1e-5, 123456789.0, -2.5, -1e7, 1e100, 1.5e-120, 100000.0, 0.1, 1234565.0, 65536.0] + [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-9, 12) for _ in range(400)]
    got = [x.g for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", numbers.six_digits(F.col("v")).alias("g")).orderBy("i").collect()]
    assert got == ["%g" % v for v in values]


def test_where_given(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, kind string")
    assert relational.where_given(rows, kind=None).count() == 3 and [r.id for r in relational.where_given(rows, kind="b", id=None).collect()] == [2]


def test_run_checks(spark):
    from citebase.operators import jobs

    runs = spark.createDataFrame([("r1", "acme"), ("r2", None)], "run_id string, brand_id string")
    assert jobs.require_run(runs, "r1", "acme") is None and jobs.require_run(runs, "r2") is None
    with pytest.raises(LookupError):
        jobs.require_run(runs, "r9")
    with pytest.raises(ValueError, match="acme"):
        jobs.require_run(runs, "r1", "other")


def test_queue(spark):
    from citebase.operators import jobs

    schema = "id int, kind string, status string, priority int, attempts int, max_attempts int, run_after timestamp, locked_at timestamp, locked_by string, last_error string"
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    rows = [(1, "a", "pending", 2, 0, 3, t, None, None, None), (2, "a", "pending", 1, 2, 3, t, None, None, "x"), (3, "b", "pending", 0, 0, 1, t + dt.timedelta(days=9), None, None, None)]
    now = F.lit(t + dt.timedelta(hours=1))
    q = jobs.claim(spark.createDataFrame(rows, schema), now, "w", ["a"])
    assert {r.id: (r.status, r.attempts, r.locked_by) for r in q.collect()} == {1: ("pending", 0, None), 2: ("running", 3, "w"), 3: ("pending", 0, None)}
    done = jobs.finish(q, spark.createDataFrame([(2, "boom"), (1, None), (77, "y")], "id int, error string"), now)
    assert {r.id: (r.status, r.last_error, r.run_after == t) for r in done.collect()} == {1: ("succeeded", None, True), 2: ("dead", "boom", False), 3: ("pending", None, False)}
    assert [tuple(r) for r in jobs.dead_letters(done).collect()] == [(2, "a", 3, "boom")]
    assert jobs.claim(q.limit(0), now, "w").count() == 0


def test_values_that_sources_get_wrong(spark):
    from citebase.functions import parsing

    items = ['[{"k":1},{"k":2}]', '"[{\\"k\\":1}]"', '{"items":[{"k":3}]}', '"{\\"items\\":[{\\"k\\":4}]}"', "nothing", None, "[]", "{broken"]
    got = [r.a if r.a is None else [x.k for x in r.a] for r in spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string").select("i", parsing.json_array(F.col("v"), "struct<k:int>", "items").alias("a")).orderBy("i").collect()]
    assert got[:5] == [[1, 2], [1], [3], [4], None] and got[5] is None and got[6] == []
    times = ["2026-08-09", "2026-08-09T10:00:00+02:00", "2026-08-09T10:00+0200", "2026-08-09 10:00:00.5Z", "09/08/2026", "2026-13-01", "", None]
    at = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(times)], "i int, v string").select("i", F.date_format(parsing.iso_time(F.col("v")), "dd HH:mm:ss").alias("t")).orderBy("i").collect()]
    assert at == ["09 00:00:00", "09 08:00:00", "09 08:00:00", "09 10:00:00", None, None, None, None]
    assert one(spark, parsing.xml_escape(F.lit("<A> & b"))) == "&lt;A&gt; &amp; b" and one(spark, parsing.xml_escape(F.lit(""))) == "-"
    assert one(spark, parsing.tail_tokens(F.lit(" a  b c "), 2)) == "b c" and one(spark, parsing.tail_tokens(F.lit(None).cast("string"), 2)) == "" and one(spark, parsing.tail_tokens(F.lit("a"), 0)) == ""


def test_covers(spark):
    of = lambda text, q: retrieval.covers(text.split(), [[t for t, neg in g if not neg] for g in retrieval.TextQuery.of(q).any_of])
    assert of("a x b b y y y a", "a b") == [(0, 2, 2), (3, 7, 2)]
    assert of("a b a", "a or b") == [(0, 0, 1), (1, 1, 1), (2, 2, 1)]
    assert of("in een raster x raster in een raster", '"een raster"') == [(1, 2, 2), (6, 7, 2)]
    assert of("a b", "a c") == [] and of("", "a") == [] and of("a b", "a -b") == [(0, 0, 1)]
    df = spark.createDataFrame([(["a", "x", "b"],), (None,), ([],)], "w array<string>")
    assert [r.r for r in df.select(retrieval.cover_density(F.col("w"), "a b").alias("r")).collect()] == [0.05, 0.0, 0.0]


def test_requirements_broadcast_no_facts(spark, sf_dir):
    """Facts exploded from a small file are many times its size: a broadcast of them is built in the driver."""
    from citebase.plans import catalogue

    for name in ("requirement_grading", "requirement_status"):
        df = catalogue.QUERIES[name](spark, sf_dir)
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_requirements_of_odd_rows(spark):
    """Doubled and null products, doubled facts, facts and keys that nobody asks for, no requirement at all."""
    products = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "product_id int")
    facts = [(1, "a", 5.0, "stated"), (1, "b", 1.0, "not_stated"), (1, "zzz", 5.0, "stated"), (2, "a", 1.0, "stated"), (2, "a", 9.0, "stated"), (2, None, 5.0, "stated"), (9, "a", 5.0, "stated"), (None, "a", 5.0, "stated")]
    none = [F.lit(None).cast(t).alias(f"value_{c}") for c, t in (("numeric_max", "double"), ("text", "string"), ("enum", "string"), ("bool", "boolean"))]
    facts = spark.createDataFrame(facts, "product_id int, key string, value_numeric double, presence string").select("*", *none)
    definitions = spark.createDataFrame([(k, {"-": 0}) for k in ("a", "b")], "key string, ordinals map<string,int>")
    asked = spark.createDataFrame([("a", ">=", "3"), ("a", "<=", "3"), ("b", ">=", "1"), (None, ">=", "1"), ("ghost", ">=", "1")], "key string, op string, value string")
    status = retrieval.evaluate_requirements(products, asked, definitions, facts)
    got = sorted((r.product_id or 0, r.key or "", r.status) for r in status.collect())
    unknown = lambda *keys: [(k, "unknown") for k in ("", "b", "ghost", *keys)]
    want = {0: unknown("a", "a"), 1: [*unknown(), ("a", "met"), ("a", "unmet")] * 2, 2: [*unknown(), *[("a", "met"), ("a", "unmet")] * 2], 3: unknown("a", "a")}
    assert got == sorted((p, *x) for p, xs in want.items() for x in xs)
    graded = {r.product_id: (r.met, r.unmet, len(r.unknown)) for r in retrieval.grade(status, strict=False).collect()}
    assert graded[2] == (["a", "a"], ["a", "a"], 2) and graded[3] == ([], [], 4)  # a key that is null is in no list
    assert retrieval.evaluate_requirements(products, asked.where("false"), definitions, facts).collect() == []
