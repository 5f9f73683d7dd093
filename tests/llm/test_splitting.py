import math
import random
from collections import Counter

from pyspark.sql import functions as F

from citebase.llm import splitting as s


def text(n, seed=1, sentence=12):
    r = random.Random(seed)
    words = []
    for i in range(n):
        topic = "abcdef"[i * 4 // max(n, 1)]
        words.append(topic + str(r.randint(0, 20)) + (".\n\n" if i % 97 == 96 else "." if i % sentence == sentence - 1 else ""))
    return "  " + " ".join(words) + "  "


def rebuilt(t, pieces):
    out, end = [], 0
    for a, b, x, y in pieces:
        starts = [m for m in splits(t)]
        out.append(t[x:y] if a == 0 else t[starts[end - 1][1] : y])
        end = b
    return "".join(out)


def splits(t):
    at, out = 0, []
    for w in t.split():
        at = t.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def test_round_trip_limits_and_overlap():
    for n in (801, 1500, 5000, 20_001):
        t = text(n)
        pieces = s.split_tokens(t)
        assert len(pieces) > 1 and all(b - a <= 800 for a, b, _, _ in pieces)
        tokens = t.split()
        for (a, b, x, y), (c, d, _, _) in zip(pieces, pieces[1:]):
            assert c == b - 120 and d > b and t[x:y].split() == tokens[a:b]
        assert rebuilt(t, pieces) == t
        cut = [tokens[b - 1] for _, b, _, _ in pieces[:-1]]
        assert all(w.endswith(".") for w in cut)


def test_no_boundaries_and_small():
    assert [(a, b) for a, b, _, _ in s.split_tokens("x " * 1000)] == [(0, 800), (680, 1000)]
    assert s.split_tokens("x " * 800) == [(0, 800, 0, 1600)] and s.split_tokens("") == [] and s.split_tokens("   ") == []
    assert len(s.split_tokens("x y z\n" * 300)) == 2
    assert [(a, b) for a, b, _, _ in s.split_tokens("a b c d e", limit=2, overlap=1)] == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_cohesion_equals_direct_count():
    r = random.Random(3)
    for _ in range(30):
        w = [r.choice("abcdefg") for _ in range(r.randint(3, 200))]
        gaps = sorted(r.sample(range(1, len(w)), min(len(w) - 1, 20)))
        sim = []
        for g in gaps:
            a, b = Counter(w[max(0, g - 60) : g]), Counter(w[g : g + 60])
            sim.append(sum(a[k] * b[k] for k in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))
        want = []
        for k, x in enumerate(sim):
            left, right, i, j = x, x, k - 1, k + 1
            while i >= 0 and sim[i] >= left:
                left, i = sim[i], i - 1
            while j < len(sim) and sim[j] >= right:
                right, j = sim[j], j + 1
            want.append(left + right - 2 * x)
        assert all(abs(a - b) < 1e-9 for a, b in zip(s.cohesion_depths(w, gaps), want))


CHUNKS = "chunk_id bigint, heading_path array<string>, content string, token_count int"
PAGES = "page_id bigint, page_tables array<struct<rows:array<array<string>>,top:double,bottom:double>>"


def test_items(spark):
    t = text(900)
    chunks = spark.createDataFrame([(1, ["Kop", "Sub"], "Kop > Sub\n\n" + t, 3), (2, ["Wrong"], t, None), (3, None, None, None), (4, [], "", 0), (5, None, text(799), 5000), (6, None, t, 1), (6, None, t, 1)], CHUNKS)
    row = ["aap noot", None, "mies"]
    pages = spark.createDataFrame([(1, [([row], 1.0, 2.0), ([row] * 400, 1.0, 2.0), (None, None, None)]), (2, None), (3, []), (4, [([row] * 266 + [None, []], 1.0, 2.0)])], PAGES)
    extra = {c: F.lit("x") for c in ("text", "item_id", "item_kind", "piece_index", "t")}
    got = s.split_items(s.long_items(chunks.withColumns(extra), pages.withColumns(extra)))
    rows = got.collect()
    assert {(r.item_kind, r.item_id, r.item_index) for r in rows} == {("chunk", 1, 0), ("chunk", 2, 0), ("chunk", 6, 0), ("table", 1, 1)}
    assert all(r.token_count <= 800 and len(r.content.split()) == r.token_count for r in rows)
    assert {r.item_id: r.heading_path for r in rows if r.item_kind == "chunk"} == {1: ["Kop", "Sub"], 2: None, 6: None}
    assert sum(r.piece_index == 0 for r in rows if r.item_id == 6) == 2
    assert s.split_items(s.long_items(chunks.limit(0), pages.limit(0))).count() == 0


def test_whole_tables_against_direct_count(spark, sf_dir):
    from citebase.llm.queries import p1_found

    got = {tuple(r) for r in p1_found(spark, sf_dir).collect()}
    want = {("chunk", r.chunk_id, 0) for r in spark.read.parquet(f"{sf_dir}/document_chunks.parquet").collect() if r.content and len(r.content.split()) > 800}
    for r in spark.read.parquet(f"{sf_dir}/document_pages.parquet").collect():
        want |= {("table", r.page_id, k) for k, t in enumerate(r.page_tables or []) if t and sum(len((c or "").split()) for row in t.rows or [] for c in row or []) > 800}
    assert got == want


def test_deepest_valley_of_the_whole_window():
    r = random.Random(1)
    # a new topic after 260 words, with sentences of one topic to the end
    words = [f"{'a' if i < 260 else 'b'}{r.randint(0, 9)}" + ("." if i % 10 == 9 else "") for i in range(900)]
    assert s.split_tokens(" ".join(words))[0][:2] == (0, 260)


def test_long_heading_path(spark):
    path = [f"Kop {i} " + "woord " * 60 for i in range(8)]
    chunks = spark.createDataFrame([(1, path, " > ".join(path) + "\n\n" + text(900), None), (2, [*path, "anders"], " > ".join(path) + "\n\n" + text(900), None)], CHUNKS)
    got = {r.item_id: r.heading_path for r in s.long_items(chunks, spark.createDataFrame([], PAGES)).collect()}
    assert len("".join(path)) > 2000 and got == {1: path, 2: None}


def walked_peaks(values):
    out = []
    for k, v in enumerate(values):
        i = k - 1
        while i >= 0 and values[i] >= v:
            v, i = values[i], i - 1
        out.append(v)
    return out


def test_peaks_equal_those_walked_to():
    import random

    from citebase.llm.splitting import _peaks

    r = random.Random(3)
    for _ in range(300):
        values = [r.choice([0.1, 0.2, 0.2, 0.5, 0.9]) for _ in range(r.randint(0, 40))]
        assert _peaks(values) == walked_peaks(values)


def test_equal_lines_take_linear_time():
    import time

    from citebase.llm.splitting import split_tokens

    at = time.perf_counter()
    pieces = split_tokens("GET /index 200 ok\n" * 200_000)
    assert time.perf_counter() - at < 30 and pieces[-1][1] == 800_000
    assert all(b - a <= 800 for a, b, _, _ in pieces)
