import random

from pyspark.sql import functions as F

from citebase.llm import leaks as k

PASSAGE = "Kamer 690 van het gebouw Magaldocourt kreeg een verlaagd veld met K943 lamellen, en de bewoner hoorde 75 procent minder verkeer. Leg uit waarom de gevel te Talorgoheim na 81 dagen scheurde."


def test_disguises():
    index = k.Index([(1, PASSAGE), (2, "Een andere passage over het plafond die met de eerste niets te maken heeft en lang genoeg is om te tellen.")])
    words = PASSAGE.split()
    for t in (PASSAGE, PASSAGE.upper(), PASSAGE.replace("Magaldo", "Magal­do").replace(" ", "  \n"), f"<p>{PASSAGE.replace('gebouw', '<b>ge</b>bouw')}</p>", "Begin. " + " ".join(words[3:19]) + " slot", PASSAGE.replace("é", "e").replace(",", ";"), PASSAGE.replace("kreeg", "k​reeg")):
        assert index.leaked(t) == {1}, t
    assert index.leaked(" ".join(words[3:18])) == set()
    assert index.leaked(" ".join(words[:12] + ["x"] + words[12:24])) == set()
    assert index.leaked("") == set() and k.Index([]).leaked(PASSAGE) == set() and k.Index([(1, "te kort"), (2, None)]).leaked(PASSAGE) == set()


def test_tags_of_any_length():
    index, words = k.Index([(1, PASSAGE)]), PASSAGE.split()
    for tag in ("<a href='https://x.example/?" + "utm=a-b&" * 60 + "'>", "<img src='data:image/png;base64," + "iVBOR/w0K+" * 500 + "'>", f"<span style='{'color: red; ' * 40}'>"):
        assert len(tag) > 300 and index.leaked(" ".join(words[:14]) + f" {tag} " + " ".join(words[14:])) == {1}
    assert k.normal_words(f"ge<b class='{'x ' * 150}'>bouw</b>") == ["gebouw"]
    assert len(k.normal_words("<a " * 200_000)) == 200_000


def brute(items, docs):
    runs = {}
    for i, p in items:
        w = k.normal_words(p or "")
        for n in range(len(w) - 15):
            runs.setdefault(tuple(w[n : n + 16]), set()).add(i)
    out = set()
    for d, t in docs:
        w = k.normal_words(t or "")
        for n in range(len(w) - 15):
            out |= {(d, i) for i in runs.get(tuple(w[n : n + 16]), ())}
    return out


def test_random_against_brute_force():
    r = random.Random(4)
    for vocabulary in (8, 60):
        items = [(i, " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randint(10, 60)))) for i in range(70)]
        docs = []
        for d in range(120):
            w = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 150))]
            for _ in range(r.randint(0, 2)):
                p = r.choice(items)[1].split()
                a = r.randrange(len(p))
                w[len(w) // 2 : len(w) // 2] = p[a : a + r.randint(12, 20)]
            docs.append((d, " ".join(w)))
        index = k.Index(items)
        assert {(d, i) for d, t in docs for i in index.leaked(t)} == brute(items, docs)


def test_whole_tables(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    want = brute([(r.item_id, r.passage) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    got = k.find_leaks(docs.withColumn("item_id", F.lit(1)), items.withColumn("doc_id", F.lit(1)))
    assert {tuple(r)[:2] for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(k, "ITEM_BOUND", 50)
    assert {tuple(r)[:2] for r in k.find_leaks(docs, items).collect()} == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, PASSAGE), (3, PASSAGE), (4, "woord " * 200_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, PASSAGE, None), (8, None, "x"), (9, "", ""), (10, PASSAGE, "B")], "item_id bigint, passage string, answer_key string")
    assert sorted(tuple(r) for r in k.find_leaks(docs, items).collect()) == [(3, 7, None), (3, 7, None), (3, 10, False), (3, 10, False)]
    assert k.find_leaks(docs.limit(0), items).count() == 0 and k.find_leaks(docs, items.limit(0)).count() == 0


def test_answers(spark):
    docs = spark.createDataFrame([(1, f"Vooraf. {PASSAGE}\n-> <b>Option</b> bé"), (2, PASSAGE + " woord" * 16 + " option be"), (3, f"{PASSAGE} woord {PASSAGE} option, B.")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, PASSAGE, "Option BE"), (2, PASSAGE, "B"), (3, PASSAGE, " ")], "item_id bigint, passage string, answer_key string")
    got = {(r.doc_id, r.item_id): r.answer_found for r in k.find_leaks(docs, items).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): None, (2, 1): False, (2, 2): False, (2, 3): None, (3, 1): False, (3, 2): True, (3, 3): None}
