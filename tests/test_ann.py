import numpy as np
import pytest
from pyspark.sql import functions as F

from citebase.operators import ann, retrieval


def table_of(spark, n, d=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    x = centres[r.integers(0, 12, n)] + 0.6 * r.normal(size=(n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>")


def test_recall_and_every_row_indexed(spark, monkeypatch):
    v = table_of(spark, 3000)
    monkeypatch.setattr(ann, "PART_ROWS", 40)  # cells in many parts
    cells = ann.fit_cells(v)
    index = ann.build_index(v, cells)
    assert sorted(r.id for r in index.select("id").collect()) == list(range(3000)) and index.select("cell", "part").distinct().count() > 60
    asked = v.where("vec_id % 50 = 0")
    want = {(r.query_id, r.id) for r in retrieval.nearest_to_each(v, asked, 10).collect()}
    got = ann.search(index, cells, asked, 10).collect()
    assert len({(r.query_id, r.id) for r in got} & want) >= 0.9 * len(want) and max(r["rank"] for r in got) == 10
    assert cells.probes < len(cells.centres) / 2  # clustered vectors need few cells
    whole = ann.search(index, cells, asked, 10, probes=len(cells.centres))
    assert {(r.query_id, r.id) for r in whole.collect()} == want  # all cells: exact


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0]), (None, [1.0, 1.0]), (6, [0.0, 2.0]), (6, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("cell", "part", "id", "v", "q")})
    cells = ann.fit_cells(v)
    got = ann.search(ann.build_index(v, cells), cells, v, 2)
    assert sorted((r.query_id, r.id, round(r.distance, 6)) for r in got.collect() if r.query_id == 1) in ([(1, 1, 0.0), (1, 6, 1.0)],)
    none = ann.fit_cells(v.limit(0))
    assert len(none.centres) == 0 and ann.search(ann.build_index(v.limit(0), none), none, v, 2).count() == 0


def test_blocks_of_queries_give_the_same(spark):
    v = table_of(spark, 400)
    whole = sorted(map(tuple, retrieval.nearest_to_each(v, v.where("vec_id % 5 = 0"), 3).collect()))
    assert sorted(map(tuple, retrieval.nearest_to_each(v, v.where("vec_id % 5 = 0"), 3, block=9).collect())) == whole
