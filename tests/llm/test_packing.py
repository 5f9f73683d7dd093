import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citebase.llm import packing as p


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 70), st.integers(1, 9), max_size=12))
def test_plan_places_all(capacity, histogram):
    filled, placed = {}, {}
    for size, start, per, container, times in p.pack_lengths(capacity, histogram):
        assert start == placed.get(size, 0)
        placed[size] = start + per * times
        for c in range(container, container + times):
            filled[c] = filled.get(c, 0) + size * per
    assert placed == {s: n for s, n in histogram.items() if s <= capacity}
    assert all(v <= capacity for v in filled.values()) and sorted(filled) == list(range(len(filled)))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=6), st.sampled_from([-1, 0, 3, 9]))
def test_fullest_is_fullest(capacity, left, bytes_):
    sums = {0}
    for s, n in left.items():
        sums = {x + s * k for x in sums for k in range(n + 1) if x + s * k <= capacity}
    taken = p.fullest(capacity, sorted(left, reverse=True), left)
    held, p.STEPS_BYTES = p.STEPS_BYTES, bytes_
    try:
        assert p.fullest(capacity, sorted(left, reverse=True), left) == taken
    finally:
        p.STEPS_BYTES = held
    assert sum(s * k for s, k in taken.items()) == max(sums) and all(k <= left[s] for s, k in taken.items())


def test_counter_counts_like_the_tokenizer():
    count, r = p.TokenCounter(), random.Random(2)
    samples = ["", "a", " a", "a ", "a  b", "a   b", "a \n b", "\n\n a", "x\ty  ", "it's 12.345 m²", "één  twee drie", " ", "  ", "a\n", "a \n"] + ["".join(r.choice("ab .\n\t1'é  ") for _ in range(30)) for _ in range(3000)]
    for s in samples:
        assert count(s) == len(count.encode(s)), repr(s)


def test_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "woord " * 30_000)], "doc_id bigint, text string"))
    sizes = spark.createDataFrame([("small", 512), ("large", 8192), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    got = p.pack(more.withColumns({c: F.lit(7) for c in ("tokens", "capacity", "size", "salt", "rank", "at", "offset", "c")}), sizes).toPandas()
    count = p.TokenCounter()
    want = {r.doc_id: count(r.text) for r in more.collect()}
    for kind, capacity in (("small", 512), ("large", 8192)):
        k = got[got.container_kind == kind]
        assert k.groupby("doc_id").tokens.sum().to_dict() == want
        assert k.groupby("container_id").tokens.sum().max() <= capacity
        cut = k.groupby("doc_id").size()
        assert all(n == max(1, -(-want[d] // capacity)) for d, n in cut.items())
        full = -(-sum(want.values()) // capacity)
        assert k.container_id.nunique() <= full * 1.02 + 1 and k.container_id.max() + 1 == k.container_id.nunique()
    assert set(got.container_kind) == {"small", "large"}
    assert p.pack(more.limit(0), sizes).count() == 0 and p.pack(more, sizes.limit(0)).count() == 0


def test_repeated_rows_are_placed_each(spark):
    docs = spark.createDataFrame([(1, "woord " * 50)] * 40, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("k", 120)], "container_kind string, capacity_tokens int")
    got = p.pack(docs, sizes).toPandas()
    assert len(got) == 40 and got.groupby("container_id").tokens.sum().max() <= 120


def test_more_kinds_than_are_planned_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "woord " * (i % 40)) for i in range(200)], "doc_id bigint, text string")
    sizes = spark.createDataFrame([("a", 64), ("b", 128), ("b", 100), ("c", 1 << 21)], "container_kind string, capacity_tokens int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(p.pack(docs, sizes))
    monkeypatch.setattr(p, "KINDS_BOUND", 1)
    assert rows(p.pack(docs, sizes)) == whole
    assert all(len({r[2] for r in whole if r[0] == k}) == 200 for k in "abc") and {r[1] for r in whole if r[0] == "c"} == {0}
