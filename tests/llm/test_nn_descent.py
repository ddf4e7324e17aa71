import numpy as np
import pytest

from tidemark.llm import nn_descent


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, float)
        if x is not None and label is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            good[i] = (x / np.abs(x).max(), label)
    links = {i: set() for i, *_ in rows}
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (x, lx), (y, ly) = good[a], good[b]
            if lx == ly and len(x) == len(y) and float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in sorted(links):
        todo = [i] if i not in comp else []
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += links[j]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.05 * rng.standard_normal(16)).tolist(), int(i % 30) % 3) for i in range(300)]
    rows += [(300 + i, (centres[0] * (1 + i)).tolist(), 0) for i in range(60)]  # one large group of copies
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, None], 0), (404, centres[0].tolist(), None), (405, [], 0), (406, [float("inf")] * 16, 1), (407, [1e300] * 16, 1), (408, [1e-300] * 16, 1)]
    return rows


def test_against_brute_force(spark, vectors):
    frame = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, embedding array<double>, label int, component_id string").repartition(4)
    out = nn_descent.near_vectors(frame)
    got = {r.vec_id: tuple(r)[1:] for r in out.collect()}
    want = brute(vectors)
    assert set(got) == set(want)
    exact = sum(got[i] == want[i] for i in want)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold
    assert found >= 0.99 * true and exact >= 0.98 * len(want)
    row = nn_descent.audit_recall(frame, out).first()
    assert row.queries == 4 and row.recall >= 0.9


def test_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    got = {r.vec_id: tuple(r)[1:] for r in nn_descent.near_vectors(frame).collect()}
    assert got == brute(rows)
    assert nn_descent.near_vectors(frame.where("false")).collect() == []


def test_two_large_groups_beside_each_other(spark):
    rng = np.random.default_rng(4)
    turn = np.arccos(0.985)
    centres = np.zeros((2, 16))
    centres[0, 0], centres[1, 0], centres[1, 1] = 1, np.cos(turn), np.sin(turn)
    rows = [(i, (centres[i % 2] + 0.001 * rng.standard_normal(16)).tolist(), 0) for i in range(80)]
    rows += [(100 + i, centres[i % 2].tolist(), 0) for i in range(60)]  # copies of thirty in each
    rows += [(200 + i, rng.standard_normal(16).tolist(), 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    assert {r.vec_id: tuple(r)[1:] for r in nn_descent.near_vectors(frame).collect()} == brute(rows)


def test_recall_on_the_larger_table_with_planted_copies(spark):
    """The given vectors hold no pair at the threshold, so near copies are planted: pairs, chains and one group; ids divisible by 100 against all."""
    rows = [(r.vec_id, np.asarray(r.embedding, dtype=np.float64), r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng, planted, at = np.random.default_rng(9), [], 1 + max(r[0] for r in rows)

    def near(v, cosine):
        side = rng.standard_normal(len(v))
        side -= v * (side @ v) / (v @ v)
        return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)

    for i, v, label in rows:
        if i % 100 == 0 or i % 7 == 0:
            one = near(v, rng.uniform(0.981, 0.99))
            chain = [one, near(one, 0.985), near(near(one, 0.985), 0.985)] if i % 3 == 0 else [one]
            planted += [(at + len(planted) + k, x, label) for k, x in enumerate(chain)]
    hub = rows[0]
    planted += [(at + len(planted) + k, near(hub[1], 0.992), hub[2]) for k in range(60)]
    frame = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in rows + planted], "vec_id long, embedding array<double>, label int").repartition(8)
    row = nn_descent.audit_recall(frame, nn_descent.near_vectors(frame)).first()
    assert row.queries >= 20 and row.links >= 80 and row.recall >= 0.95
    bare = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert nn_descent.audit_recall(bare, nn_descent.near_vectors(bare)).first().recall is None


def test_repeated_ids_and_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_rounds_in_half_precision_lose_no_link():
    """Cosines within ``MARGIN``, also of very long vectors and very unequal components; offers are the best others above what is known."""
    rng = np.random.default_rng(4)
    for size in (2, 64, 4096):
        x = nn_descent.unit(list(rng.standard_normal((40, size)) * 10.0 ** rng.integers(-9, 9, (40, 1)) * np.where(rng.random((40, size)) < 0.1, 30, 1)))
        x = nn_descent.unit(list(np.concatenate([x, x + rng.standard_normal(x.shape) * 0.2 / size**0.5])))
        half = x.astype("<f2")
        ids, starts = np.arange(len(x)) * 10, np.asarray([0, len(x)])
        a, b, similar = nn_descent.met_around(ids, starts, [half], np.full(len(x), -2.0), 5)
        true = x @ x.T
        assert np.abs(similar - true[a // 10, b // 10]).max() < nn_descent.MARGIN and len(a) == 5 * len(x)
        np.fill_diagonal(true, -2)
        assert (true.max(axis=1) - np.asarray([similar[a == i].max() for i in ids]) < nn_descent.MARGIN).all()
        better = nn_descent.met_around(ids, starts, [half], np.full(len(x), 0.9), 5)
        assert sorted(zip(*better, strict=True)) == sorted(z for z in zip(a, b, similar, strict=True) if z[2] > 0.9)


def test_vectors_travel_packed(spark, vectors):
    """A round carries bytes of two for each component, and what is offered is shuffled once for the group and its best."""
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label long")
    points = nn_descent.usable(frame, "vec_id", "embedding", "label").dropDuplicates(["_id"])
    graph = spark.createDataFrame([(0, 1, 0.5)], "_id long, _other long, _sim double")
    plan = nn_descent.refine(nn_descent.halved(points), graph, 4)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Exchange hashpartitioning(") == 1
    packed = {r._id: r._b for r in nn_descent.halved(points).collect()}
    assert {r._id: 2 * len(r._v) for r in points.collect()} == {i: len(b) for i, b in packed.items()}
