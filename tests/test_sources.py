import json

import pytest
from pyspark.sql import functions as F

from citebase.sources import files, sinks
from citebase.streaming import latest

HTML = """<html><head><title> Acme  plafond </title><style>x</style></head><body><nav><p>menu</p></nav>
<h1>Systeemplafonds</h1><h2>Brandwerendheid</h2><p>Tekst &amp; meer</p><table><tr><th>Spec</th><th>Waarde</th></tr><tr><td>Brandklasse</td><td>A2-s1,d0</td></tr></table><footer>voet</footer></body></html>"""


def test_parse_pages(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p>open")], "id int, html string")
    got = {r.id: r.page for r in files.parse_pages(df).collect()}
    assert got[1].title == "Acme plafond" and got[1].text == "Systeemplafonds\nBrandwerendheid\nTekst & meer"
    assert [x.avg_font_size for x in got[1].page_lines] == [24.0, 18.0, 14.0]
    assert got[1].page_tables[0].rows == [["Spec", "Waarde"], ["Brandklasse", "A2-s1,d0"]]
    assert got[2].text == "" and got[3].title is None and got[4].text == "open"


def test_nested_and_empty_elements():
    p = files.parse_page("<div>los<ul><li>een <b>twee</b><p>drie</p></li><li></li></ul><table><tr><td></td></tr><tr><td> a </td><td></td></tr></table><script>x</script></div>")
    assert [x["text"] for x in p["page_lines"]] == ["een twee drie"] and p["page_tables"] == [{"rows": [["a", None]], "top": 1.0, "bottom": 2.0}]


def test_documents_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo")
    (tmp_path / "b.txt").write_bytes(b"one\ntwo")
    (tmp_path / "c.txt").write_bytes(b"bad")

    def parser(content):
        if content == b"bad":
            raise ValueError("no text")
        return [{"page_number": i, "text": t} for i, t in enumerate(content.decode().split("\n"), 1)]

    got = files.documents(spark, str(tmp_path), parser, "page_number int, text string", "*.txt")
    assert got.where("error is null").count() == 4 and got.where("error = 'no text'").count() == 1
    assert files.new_files(got.select("sha256"), got.where("error is not null")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a", "url": "u"}, {"file": " ", "url": "u"}]))
    assert [r.problem for r in files.manifest(spark, str(tmp_path / "m.json"), ["file", "url"]).orderBy(F.desc("file")).collect()] == [None, "file missing"]
    assert files.content_path("acme", "abcd", ".pdf") == "acme/ab/abcd.pdf"


def test_embed(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "id int, text string")
    got = {r.id: r.embedding for r in files.embed(df, "text", lambda ts: [[float(len(t)), 0.0] for t in ts], 2).collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: [3.0, 0.0]}
    with pytest.raises(Exception, match="another number or length"):
        files.embed(df, "text", lambda ts: [[1.0] for _ in ts], 2).collect()


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(1, True), (2, False)], "id int, is_current boolean")
    sinks.write_current(log, str(tmp_path / "t"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "t")).where("is_current = 'true'").collect()] == [1]
    s = sinks.report_sections("r", [("one", log), ("two", log.limit(0))])
    assert [(r.position, r.body) for r in s.orderBy("body").collect()] == [(0, '{"id":1,"is_current":true}'), (0, '{"id":2,"is_current":false}')]
    m = spark.range(1).select(sinks.merge_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')).alias("m"), sinks.merge_json(F.lit(None).cast("string"), F.lit('{"b":"3"}')).alias("n")).first()
    assert m.m == {"a": "1", "b": "3"} and m.n == {"b": "3"}


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.limit(200).write.parquet(str(tmp_path / "in"))
    src = latest.file_stream(spark, str(tmp_path / "in"))
    dedup = latest.deduplicated(src.withColumn("at", F.col("ts").cast("timestamp")), ["user_id"], "at")
    assert latest.run_available(dedup, "dedup", "append").count() > 0
    counts = latest.run_available(latest.windowed_counts(src.withColumn("at", F.col("ts").cast("timestamp")), "at", ["event_type"]), "counts")
    assert counts.agg(F.sum("n")).first()[0] == 200
    sink = latest.idempotent_sink(str(tmp_path / "out"), ["event_id"])
    for _ in range(2):  # a repeated batch adds nothing
        q = src.writeStream.foreachBatch(sink).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_sink_does_not_hide_errors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "k int, v string")
    write = latest.idempotent_sink(str(tmp_path / "s"), ["k"])
    write(rows, 0), write(rows, 0), write(rows.limit(0), 1)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "_bucket=1").mkdir()
    (tmp_path / "bad" / "_bucket=1" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        for i in range(200):
            latest.idempotent_sink(str(tmp_path / "bad"), ["k"], buckets=2)(spark.createDataFrame([(i, "a")], "k int, v string"), 0)


def test_content_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("acme", ".pdf", bytearray(b"one")), ("acme", "pdf", bytearray(b"one")), ("b", "txt", bytearray(b"two")), ("b", "txt", None)], "slug string, extension string, content binary").coalesce(1)
    assert sorted(r.stored for r in files.store(rows, root).collect()) == [False, True, True]
    assert not any(r.stored for r in files.store(rows, root).collect())
    got = files.load(spark, root, "acme").collect()
    assert len(got) == 1 and bytes(got[0].content) == b"one" and got[0].path.endswith(files.content_path("acme", got[0].sha256, "pdf"))
    assert files.load(spark, root).count() == 2


def test_fetches_and_answers(spark):
    def fetcher(url):
        if "down" in url:
            raise OSError("no route")
        return (404, "") if "gone" in url else (200, url.upper())

    urls = spark.createDataFrame([("a",), ("a",), ("gone",), ("down",), (None,)], "url string")
    assert sorted(map(tuple, files.fetched(urls, fetcher).collect()), key=str) == [("a", 200, "A", None), ("down", None, None, "no route"), ("gone", 404, "", None)]

    def engine(text):
        if not text:
            raise ValueError("empty prompt")
        return {"response_text": text[::-1], "citations": ["u", "u"], "input_tokens": 3}

    got = sorted(files.answers(spark.createDataFrame([(1, "ab"), (2, None)], "prompt_id bigint, text string"), engine, 2).collect(), key=lambda r: (r.prompt_id, r.replicate_index))
    assert [(r.prompt_id, r.replicate_index, r.error, r.response_text, r.citations, r.output_tokens) for r in got] == [(1, 0, None, "ba", ["u", "u"], None), (1, 1, None, "ba", ["u", "u"], None), (2, 0, "empty prompt", None, None, None), (2, 1, "empty prompt", None, None, None)]


def test_sparse_pages_are_read_again(spark):
    def reader(path, number):
        if number == 3:
            raise OSError("no image")
        return f"seen {path}"

    rows = spark.createDataFrame([("p", 1, "x" * 40), ("p", 2, "  short "), ("p", 3, "stays"), ("p", 4, None)], "path string, page_number int, text string")
    got = {r.page_number: (r.text, r.used_fallback) for r in files.with_fallback(rows, reader).collect()}
    assert got == {1: ("x" * 40, False), 2: ("seen p", True), 3: ("stays", False), 4: ("seen p", True)}


def test_manifest_rules_and_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a.pdf", "url": "https://x.example", "date": "2026-01-02"}, {"file": "b.pdf", "url": "ftp:x", "date": None}, {"file": "c.pdf", "url": "https://y.example", "date": "soon"}]))
    m = files.manifest(spark, str(tmp_path / "m.json"), ["file"], {"url": "https?://.+", "date": r"\d{4}-\d{2}-\d{2}"})
    assert {r.file: r.problem for r in m.collect()} == {"a.pdf": None, "b.pdf": "url invalid", "c.pdf": "date invalid"}
    listing = spark.createDataFrame([("file:/d/a.pdf",), ("file:/d/z.pdf",)], "path string")
    assert {(r.file, r.state) for r in files.manifest_files(m, listing).collect()} == {("a.pdf", "there"), ("b.pdf", "missing"), ("c.pdf", "missing"), ("z.pdf", "unlisted")}


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_formats(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string")
    rows.write.format(kind).option("header", "true").partitionBy("id").save(str(tmp_path / kind))
    got = files.read_table(spark, str(tmp_path / kind), kind, "name string, id bigint").where("id = 1")
    assert [tuple(r) for r in got.select("id", "name").collect()] == [(1, "a")]


def test_table_list_and_html(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    assert ("some_view", "TEMPORARY") in {tuple(r) for r in files.table_list(spark).collect()}
    s = sinks.report_sections("r", [("A & B", spark.createDataFrame([("<x>",)], "name string")), ("two", spark.createDataFrame([("y",)], "name string"))])
    assert [r.html for r in sinks.render_html(s).collect()] == ['<html><body><h2>A &amp; B</h2><ul><li>{"name":"&lt;x&gt;"}</li></ul><h2>two</h2><ul><li>{"name":"y"}</li></ul></body></html>']
