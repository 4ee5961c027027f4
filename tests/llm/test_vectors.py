import numpy as np
import pytest

from marginalia.llm import curve_search
from marginalia.llm.common import table
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    dim = max((len(v) for _, v in rows if v), default=0)
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault((i, tuple(v)), np.array(v, np.float64))
    out = {}
    for (q, _), x in good.items():
        if q % every == 0:
            near = sorted((np.sqrt(((y - x) ** 2).sum()), i) for (i, _), y in good.items() if i != q)
            out[q] = near[:k]
    return out


def test_hilbert_is_a_curve():
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    key = curve_search.hilbert(cells, 4)
    way = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(256)) and (np.abs(np.diff(way, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf, monkeypatch):
    monkeypatch.setattr(curve_search, "BLOCK", 200)
    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows)
    got: dict = {}
    for r in curve_search.op3(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all([k for _, _, k in v] == list(range(1, 11)) for v in got.values())


def test_window_is_a_part_of_clustered_data():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(300, 16))[:, None] * 5 + rng.normal(size=(300, 20, 16))).reshape(-1, 16)
    c = curve_search.Curves(x, 10, 10**8, 10**6)
    assert c.window <= 0.03 * len(x) and c.ranges > 1000


def test_hot_vectors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(curve_search, "BLOCK", 50)
    rng = np.random.default_rng(1)
    v = [[float(t) for t in rng.normal(size=6).astype("float32")] for _ in range(60)]
    rows = [(i, v[0] if i % 3 == 0 else v[i % 60]) for i in range(400)] + [(5, v[7]), (100, v[9]), (5, v[7]), (999, [1e200, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in curve_search.search(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((pytest.approx(r["score"], abs=1e-6), r["vec_id"]))
    vectors: dict = {}
    for i, x in rows:
        vectors.setdefault(i, []).append(np.array(x))
    for q in (0, 100, 200, 300):
        with np.errstate(over="ignore"):
            near = sorted((min(np.sqrt(((y - x) ** 2).sum()) for x in vectors[q] for y in ys), i) for i, ys in vectors.items() if i != q)[:5]
        assert got[q] == near
    few = df.where("vec_id IN (0, 999)").select("vec_id", "embedding")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in curve_search.search(few).collect()] == [(0, 999, pytest.approx(1e200))]


def test_edges(spark):
    rng = np.random.default_rng(0)
    v = [float(x) for x in rng.normal(size=6).astype("float32")]
    w = [float(x) for x in rng.normal(size=6).astype("float32")]
    rows = [(i, v) for i in range(0, 40)] + [(100, w), (100, w), (200, None), (300, [0.0] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [1.0]), (None, v), (700, [])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).selectExpr("*", "'c' AS curve", "1 AS rank")
    got: dict = {}
    for r in curve_search.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == {q: [(pytest.approx(float(d)), i) for d, i in near] for q, near in brute(rows).items()}
    assert curve_search.search(df.where("false")).collect() == []
    few = curve_search.search(df.where("vec_id IN (0, 3, 100)")).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(0, 3), (0, 100), (100, 0), (100, 3)}
