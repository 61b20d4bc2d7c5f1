import numpy as np
import pytest

from inkmill.operators import vectors as E

SCHEMA = "row bigint, embedding array<float>"


def test_cosine_of_same_orthogonal_and_zero(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], SCHEMA)
    assert E.top_k(store, [1, 0, 0], 1).first().score == pytest.approx(1.0)
    assert E.top_k(store, [0, 1, 0], 1).first().score == pytest.approx(0.0)
    assert E.top_k(store, [0, 0, 0], 1).first().score == 0.0
    with pytest.raises(Exception, match="differ in size"):
        E.top_k(store, [1, 0], 1).collect()


def test_top_k_order_and_ties(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7071, 0.7071]), (3, [0.0, 1.0]), (4, [2.0, 0.0])], SCHEMA)
    assert [r.row for r in E.top_k(store, [1, 0], 3).collect()] == [1, 4, 2]
    assert E.top_k(store, [1, 0], 0).collect() == []


def test_top_k_of_each_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    store = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = E.top_k_of_each(store, store.where("row % 50 = 0").withColumnRenamed("row", "query"), 4, 8).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in range(0, 300, 50):
        want = sorted(range(300), key=lambda i: (-round(float(u[i] @ u[q]), 9), i))[:4]
        assert [r.row for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == want
    empty = spark.createDataFrame([], SCHEMA)
    assert E.top_k_of_each(empty, empty.withColumnRenamed("row", "query"), 4, 8).collect() == []


def test_keeping_and_deleting(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 20), ("b", 20), ("c", 30), (None, 9)], "k string, v int")
    assert {tuple(r) for r in E.upsert(old, new, "k").collect()} == {("a", 1), ("b", 20), ("c", 30), (None, 3)}
    t = spark.createDataFrame([("n", "v1", 1), ("n", "v2", 2), (None, None, 3)], "novel string, version string, x int")
    assert {r.x for r in E.delete(t, novel="n", version="v1").collect()} == {2, 3}
    assert E.delete(t).count() == 3
    with pytest.raises(ValueError):
        E.delete(t, colour="red")
    kept = E.upsert(spark.createDataFrame([("a", 1, "m"), ("b", 2, "o")], "k string, v int, meta string"), spark.createDataFrame([("a", 9, None), ("b", 8, "p"), ("c", 7, None)], "k string, v int, meta string"), "k", ("meta",))
    assert {tuple(r) for r in kept.collect()} == {("a", 9, "m"), ("b", 8, "p"), ("c", 7, None)}
    s = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", 0, 9), (None, 1, 1)], "k string, at int, row int")
    assert [tuple(r) for r in E.latest(s, "k", "at", "row").collect()] == [("a", 1, 7)]


def test_a_batch_of_scenes_and_vectors(spark):
    scenes = spark.createDataFrame([("a", 1), (None, 2)], "id string, x int")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<float>")
    assert [tuple(r) for r in E.with_vectors(scenes, vectors).collect()] == [("a", 1, [1.0])]
    with pytest.raises(ValueError, match="2 scenes and 1 vectors"):
        E.with_vectors(scenes, vectors.limit(1))


def test_best_of_ties():
    score = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf], [-np.inf] * 5])
    who, which = E.best_of(score, np.array([9, 8, 3, 4, 1]), 2)
    assert who.tolist() == [0, 0] and which.tolist() == [1, 2]


@pytest.mark.parametrize("text", ['{"model": {"vocab": {"一": 5, "ab": 6}}}', '{"vocab": {"一": 5, "ab": 6}}', '{"一": 5, "ab": 6}'])
def test_vocabularies(spark, tmp_path, text):
    (tmp_path / "v.json").write_text(text)
    assert {tuple(r) for r in E.vocabulary_of(spark, str(tmp_path / "v.json")).collect()} == {("一", 5), ("ab", 6)}
    got = E.character_ids(spark.createDataFrame([(1, "一😀")], "doc bigint, text string"), E.vocabulary_of(spark, str(tmp_path / "v.json"))).first()
    assert got.ids == [101, 5, 100, 102] and got.n == 4


def test_hashed_embedding_is_unit_and_deterministic(spark):
    t = spark.createDataFrame([(1, "你好世界"), (2, "你好世界"), (3, "再见"), (4, "x"), (5, None), (6, "")], "doc bigint, text string")
    v = {r.doc: r.embedding for r in E.hashed_embedding(t).collect()}
    assert set(v) == {1, 2, 3} and v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1)
    assert sum(a * b for a, b in zip(v[1], v[3])) < 0.95


def test_character_ids(spark):
    t = spark.createDataFrame([(1, "ab?"), (2, ""), (3, None), (4, "a" * 600)], "doc bigint, text string")
    v = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    got = {r.doc: r.ids for r in E.character_ids(t, v).collect()}
    assert got[1] == [101, 1, 2, 100, 102] and got[2] == [101, 102] and 3 not in got and len(got[4]) == 512


def _is_best(store, asked, got, k):
    """Whether ``got`` is the exact result for lists of (row, unit vector, own values), None in a query being no limit."""
    for q, u, wanted in asked:
        fit = [(r, v) for r, v, own in store if all(w is None or w == o for w, o in zip(wanted, own))]
        want = sorted((-round(float(u @ v), 9), r) for r, v in fit)[:k]
        if [(r, -s) for s, r in want] != [(row, score) for query, row, score in got if query == q]:
            return False
    return True


def test_the_best_of_rows_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    x = centre + rng.standard_normal((9000, 16)) * np.where(rng.random(9000) < 0.5, 1e-4, 1)[:, None]
    x[5000:5040] = x[17]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = rng.permutation(9000) + 10
    none, free = np.zeros((9000, 0), np.int64), np.zeros((9000, 0), bool)
    best = E.Best(rows[:300], x[:300], none[:300], free[:300], 25)
    for low in (0, 100, 6000):
        high = {0: 100, 100: 6000, 6000: 9000}[low]
        best.see(rows[low:high], x[low:high], none[low:high], free[low:high])
    got = list(zip(*(a.tolist() for a in best.found())))
    assert _is_best([(r, v, ()) for r, v in zip(rows.tolist(), x)], [(r, v, ()) for r, v in zip(rows[:300].tolist(), x)], got, 25)


def test_a_search_sends_no_pairs_of_both_sides_and_keeps_to_limits(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    own = [(None if i % 11 == 0 else f"w{i % 3}", f"v{i % 2}") for i in range(400)]
    store = spark.createDataFrame([(i, v.tolist(), *o) for i, (v, o) in enumerate(zip(x, own))], SCHEMA + ", novel string, version string")
    asked = [(i, x[i].tolist(), (None, "w1", "w2", "none")[i % 4], (None, "v0", "v1")[i % 3]) for i in range(0, 400, 7)]
    queries = spark.createDataFrame(asked, "query bigint, embedding array<float>, novel string, version string")
    found = E.top_k_of_each(store, queries, 6, 8, ("novel", "version"))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = [(r.query, r.row, r.score) for r in found.orderBy("query", "rank").collect()]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert _is_best([(i, u[i], own[i]) for i in range(400)], [(q, u[q], (a, b)) for q, _, a, b in asked], got, 6)


@pytest.mark.parametrize("shape", [(3, 8), (5, 7), (1, 3), (4, 0)])
def test_places_of_a_mask(shape):
    mask = np.random.default_rng(2).random(shape) < 0.3
    assert E._few(mask).tolist() == np.flatnonzero(mask).tolist()


@pytest.mark.parametrize("cores, limited, want", [(6, False, 12), (8, False, 16), (24, False, 24), (2, False, 12), (6, True, 18), (24, True, 48)])
def test_slices_of_one_size_are_few(cores, limited, want):
    assert E.slices(cores, limited) == want
