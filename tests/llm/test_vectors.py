import numpy as np

from gristmill.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, unit long, rep long"


def table(spark, x, labels, extra=()):
    rows = [(i, [float(c) for c in v], int(g), "d", 1, 2) for i, (v, g) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows + [(*r, "d", 1, 2) for r in extra], SCHEMA)


def clustered(rng, n=400, d=16):
    centres = rng.normal(size=(30, d))
    x = np.concatenate([centres[rng.integers(0, 30, n)] + 0.05 * rng.normal(size=(n, d)), rng.normal(size=(n, d))]).astype(np.float32)
    x[:40] = x[0]
    return x, rng.integers(0, 2, len(x))


ODD = [(5006, [1.0] * 15, 1), (5007, [1.0] * 17, 0), (5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 1), (5004, [1.0] * 16, None), (None, [1.0] * 16, 1), (5005, [float("inf")] + [1.0] * 15, 0)]


def test_links(spark):
    x, labels = clustered(np.random.default_rng(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.linked(table(spark, x, labels, ODD), pivots=64, block=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(hit, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            break
        comp = new
    right = sum(got[i] == (int(hit[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x)))
    assert right >= 0.98 * len(x)
    assert all(got[i][0] <= hit[i].sum() for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in range(5000, 5008))


def test_nearest(spark):
    x, labels = clustered(np.random.default_rng(3))
    got = {}
    for r in vectors.nearest(table(spark, x, labels, ODD), rerank=100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    u = np.concatenate([x.astype(float), np.ones((1, 16))])
    ids = np.append(np.arange(len(x)), 5004)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        best = [ids[i] for i in np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = got[q]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        for rank, (v, score) in mine.items():
            assert abs(score - s[list(ids).index(v)]) < 1e-9
        found += sum(abs(s[list(ids).index(mine[k + 1][0])] - s[list(ids).index(b)]) < 1e-9 for k, b in enumerate(best))
    assert found >= 0.9 * 5 * len(range(0, len(x), 50))


def test_ties_go_to_the_smaller_id(spark):
    """Many exact copies and the same vector scaled: every one is as near as the others, whatever the blocks."""
    x = [[float(c) for c in np.eye(16)[i % 16]] for i in range(900)]
    rows = [(i, v if i % 2 else [2 * c for c in v], 1, "d", 1, 2) for i, v in enumerate(x)] + [(50, x[50], 1, "d", 1, 2), (3, x[3], 1, "d", 1, 2)]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, SCHEMA), rerank=8, queries_block=4, codes_block=100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(got) == list(range(0, 900, 50))
    for q, mine in got.items():
        assert [mine[k] for k in range(1, 6)] == [i for i in range(q % 16, 900, 16) if i != q][:5]


def test_blocks_do_not_change_the_answer(spark):
    x, labels = clustered(np.random.default_rng(6), n=900)
    data = table(spark, x, labels, ODD)
    assert {tuple(r) for r in vectors.nearest(data, rerank=2000, queries_block=7, codes_block=10**6).collect()} == {tuple(r) for r in vectors.nearest(data, rerank=2000).collect()}


def test_index_follows_the_vectors(spark):
    assert vectors.index_size(10**4) == (256, 8)
    sizes = [vectors.index_size(10**k) for k in range(4, 11)]
    assert sizes == sorted(sizes) and sizes[-1][0] > 2000 and all(336 * 10**k / (p**3) <= 64.1 for k, (p, _) in zip(range(4, 11), sizes))


def test_long_lists_meet_in_blocks(spark):
    rows = [(1, 7, c, True) for c in range(300)] + [(1, 8, c, False) for c in range(5)] + [(2, 7, 1000, False), (2, 7, 1001, True), (2, 9, 4, True), (2, 7, 1002, False)]
    lists = spark.createDataFrame(rows, "label int, list long, cell_id long, nearest boolean")
    got = sorted(tuple(r) for r in vectors._candidates(lists, 16, 3).collect())
    assert got == [(a, b, 1 + (b < 5)) for a in range(300) for b in range(a + 1, 300)] + [(1000, 1001, 1), (1001, 1002, 1)]


def test_small_and_empty(spark):
    few = table(spark, np.eye(3, 16), [0, 0, 1])
    assert {(r["query_id"], r["vec_id"]) for r in vectors.nearest(few, every=2).collect()} == {(0, 1), (0, 2), (2, 0), (2, 1)}
    none = few.where("vec_id < 0")
    assert vectors.nearest(none).count() == 0 and vectors.linked(none).count() == 0
    assert vectors.linked(few).count() == 3


def test_groups_of_a_dense_label_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (np.ones(16) + 0.02 * rng.normal(size=(1500, 16))).astype(np.float32)
    data, largest = table(spark, x, [1] * len(x)), []
    plain = type(data).groupBy

    def grouped(self, *keys):
        if [k for k in keys if isinstance(k, str)] == ["g"]:
            largest.append(plain(self, "g").count().agg({"count": "max"}).first()[0])
        return plain(self, *keys)

    monkeypatch.setattr(type(data), "groupBy", grouped)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.linked(data, pivots=64, block=8, together=8).collect()}
    assert got == {i: (len(x) - 1, 0) for i in range(len(x))}
    assert len(largest) == 1 and largest[0] <= 400


def test_recall_of_the_index_at_the_threshold():
    """Pairs of cosine 0.93 to 0.95: what the rule of shared counts and order retrieves, without Spark."""
    rng = np.random.default_rng(5)
    for d, n in ((16, 10_000), (64, 50_000), (256, 1_000_000)):
        pivots, prefix = vectors.index_size(n)
        p = vectors.matrix(vectors.pa.array(list(rng.normal(size=(pivots, d)))))
        x = vectors.matrix(vectors.pa.array(list(rng.normal(size=(1500, d)))))
        z = rng.normal(size=x.shape)
        z = vectors.matrix(vectors.pa.array(list(z - (z * x).sum(1, keepdims=True) * x)))
        cosine = rng.uniform(0.93, 0.95, (1500, 1))
        y = cosine * x + np.sqrt(1 - cosine**2) * z
        a, b = (np.argsort(-(v @ p.T), 1)[:, :prefix].tolist() for v in (x, y))
        shared = np.array([len(set(i) & set(j)) for i, j in zip(a, b)])
        nearest = np.array([i[0] in j or j[0] in i for i, j in zip(a, b)])
        assert ((shared > 3) | (shared == 3) & nearest).mean() >= 0.98, d


def test_candidates_count_what_cells_share(spark):
    """Against sets of pivots: more than three shared, or three with the nearest of either; lists in blocks meet once."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    cells = {k: [int(v) for v in rng.permutation(12)[:6]] for k in range(60)}
    rows = [(k % 2, k, hash(c), cell[0] in c) for k, cell in cells.items() for c in combinations(sorted(cell), 3)]
    lists = spark.createDataFrame(rows, "label int, cell_id long, list long, nearest boolean")
    right = set()
    for i, j in combinations(cells, 2):
        both = set(cells[i]) & set(cells[j])
        if i % 2 == j % 2 and (len(both) > 3 or len(both) == 3 and both & {cells[i][0], cells[j][0]}):
            right.add((i, j, len(both) * (len(both) - 1) * (len(both) - 2) // 6))
    for block in (3, 1000):
        assert {tuple(r) for r in vectors._candidates(lists, block, 3).collect()} == right


def test_near_ones_within_dense_groups_and_far_from_zero(spark):
    rng = np.random.default_rng(9)
    for x in (1 + 0.01 * rng.normal(size=(3000, 16)), np.eye(16)[rng.integers(0, 3, 3000)] + 0.001 * rng.normal(size=(3000, 16))):
        x = x.astype(np.float32)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        cosine = unit[::50] @ unit.T
        cosine[np.arange(60), np.arange(0, 3000, 50)] = -9
        fifth = np.sort(cosine, axis=1)[:, -5]
        rows = vectors.nearest(table(spark, x, np.zeros(3000)), rerank=60).collect()
        assert len(rows) == 300 and np.mean([cosine[r["query_id"] // 50, r["vec_id"]] >= fifth[r["query_id"] // 50] - 1e-13 for r in rows]) >= 0.95
