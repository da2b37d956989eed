import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import vectors as V


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def unit(n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pairs_and_nearest_against_brute_force(spark):
    x = unit(60, 4)
    s = x @ x.T
    got = {(r["a"], r["b"]) for r in V.similar_pairs(frame(spark, x), 0.8).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.8}
    near = {(r["vec_id"], r["rank"]): r["neighbour"] for r in V.nearest(frame(spark, x).where("vec_id % 20 = 0"), frame(spark, x), 3).collect()}
    for i in (0, 20, 40):
        order = [j for j in np.argsort(-s[i]) if j != i][:3]
        assert [near[i, k + 1] for k in range(3)] == order


def test_pairs_of_clustered_vectors(spark, monkeypatch):
    """Blocks around pivots that are too far apart never meet, and no pair is lost."""
    monkeypatch.setattr(V, "BLOCK", 20)
    centres = unit(6, 16, 7)
    x = np.repeat(centres, 30, axis=0) + 0.1 * unit(180, 16, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = frame(spark, x).unionByName(spark.createDataFrame([(1000, None)], "vec_id long, embedding array<double>"))
    s = x @ x.T
    assert {(r["a"], r["b"]) for r in V.similar_pairs(f, 0.9).collect()} == {(i, j) for i in range(180) for j in range(i + 1, 180) if s[i, j] >= 0.9}
    assert V.similar_pairs(f.where("false"), 0.9).count() == 0


def test_chains_against_whole_search():
    """Nearest-neighbour chains give what merging the nearest pair again and again gives."""

    def slowly(x, t, linkage):
        groups = [[i] for i in range(len(x))]
        d = np.clip(1 - x @ x.T, 0, 2)
        far = lambda a, b: (d[np.ix_(a, b)].max() if linkage == "complete" else d[np.ix_(a, b)].mean())
        while len(groups) > 1:
            best = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if best[0] > 1 - t:
                break
            groups[best[1]] += groups.pop(best[2])
        return sorted(map(sorted, groups))

    for seed in range(12):
        x = unit(25, 5, seed)
        for how in ("average", "complete"):
            for t in (0.2, 0.5, 0.8, -1.0):
                lab = V._agglomerate(x, t, how)
                got = sorted(sorted(np.flatnonzero(lab == k).tolist()) for k in set(lab.tolist()))
                assert got == slowly(x, t, how) and all(k == min(np.flatnonzero(lab == k)) for k in set(lab.tolist()))


def test_linkage(spark):
    # cosines ab .80, ac .85, bc .40
    x = np.linalg.cholesky(np.array([[1, 0.8, 0.85], [0.8, 1, 0.4], [0.85, 0.4, 1]]) + 1e-9 * np.eye(3))
    f = frame(spark, x)
    groups = lambda how, t: {r["vec_id"]: r["group_id"] for r in V.pairwise_grouping(f, t, how).collect()}
    assert groups("single", 0.7) == {0: 0, 1: 0, 2: 0}
    assert groups("complete", 0.7) == {0: 0, 1: 1, 2: 0}
    assert groups("average", 0.69) == {0: 0, 1: 1, 2: 0}


def test_components(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (7, 7)], "a long, b long")
    v = spark.createDataFrame([(i,) for i in list(range(31)) + [50, 51, 99]], "v long")
    got = {r["v"]: r["group_id"] for r in V.min_label(p, v).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50 and got[99] == 99


def test_components_with_a_hot_vertex(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT_LEAST", 10)
    p = spark.createDataFrame([(9, i) for i in range(10, 80)] + [(80, 81), (81, 82)], "a long, b long")
    v = spark.createDataFrame([(i,) for i in range(9, 84)], "v long")
    assert {r["v"]: r["group_id"] for r in V.min_label(p, v).collect()} == {**{i: 9 for i in range(9, 80)}, 80: 80, 81: 80, 82: 80, 83: 83}


def test_density_of_one_tree(spark):
    x = np.repeat(unit(4, 6, 2), 5, axis=0) + 0.05 * unit(20, 6, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["vec_id"]: r["group_id"] for r in V.density_grouping(frame(spark, x), link=-1.0).collect()}
    lab = V.density_labels(x)
    assert got == {i: int(np.flatnonzero(lab == lab[i])[0]) if lab[i] >= 0 else -1 for i in range(20)}


def test_medoid_and_matches(spark):
    x = unit(20, 3, 1)
    f = frame(spark, x)
    g = f.select("vec_id", (F.col("vec_id") % 2).alias("group_id"))
    for r in V.medoids(f, g).collect():
        idx = [i for i in range(20) if i % 2 == r["group_id"]]
        assert r["central_id"] == idx[int(np.argmax((x[idx] @ x[idx].T).mean(axis=1)))]
    s = spark.createDataFrame([("q", "A", 0, 0.5), ("q", "A", 1, 0.7), ("q", "B", 2, 0.7), ("q", "C", 3, 0.1)], "query string, id string, ord int, score double")
    assert [(r["rank"], r["id"]) for r in V.top_matches(s, 2, 0.2).orderBy("rank").collect()] == [(1, "A"), (2, "B")]


def test_density():
    a = unit(1, 8, 3) + 0.01 * unit(6, 8, 4)
    b = unit(1, 8, 9) + 0.01 * unit(6, 8, 5)
    x = np.vstack([a, b])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = V.density_labels(x)
    assert len(set(lab[:6]) & set(lab[6:]) - {-1}) == 0 and (lab >= 0).any()
    assert (V.density_labels(x[:1]) == -1).all()
