from __future__ import annotations

import numpy as np
import pytest

from trajecta.operators import alignment, clustering, evaluation, modelling, simulation
from trajecta.operators.alignment import Costs, extension_at, mismatch_at, sequence_distance, warp


def slow_warp(x, y, c):
    m, e = np.array(c.mismatch), np.array(c.extension)
    one = lambda f, v: float(f(np.array([v]), e)[0])
    r, q = len(x), len(y)
    d = np.full((r + 1, q + 1), np.inf)
    d[0, 0] = 0
    du, dl = np.zeros((r + 1, q + 1)), np.zeros((r + 1, q + 1))
    for i in range(r):
        for j in range(q):
            a, b = (x[i], y[j]) if int(x[i]) <= int(y[j]) else (y[j], x[i])
            cost = float(mismatch_at(np.array([a]), np.array([b]), m)[0])
            o = (d[i, j], d[i, j + 1] + c.alpha * (du[i, j + 1] + 1) * one(extension_at, y[j]), d[i + 1, j] + c.alpha * (dl[i + 1, j] + 1) * one(extension_at, x[i]))
            k = 0 if o[0] <= o[1] and o[0] <= o[2] else (1 if o[1] <= o[0] and o[1] <= o[2] else 2)
            d[i + 1, j + 1] = cost + o[k]
            if k == 1:
                du[i + 1, j + 1] = du[i, j + 1] + 1
            if k == 2:
                dl[i + 1, j + 1] = dl[i + 1, j] + 1
    i, j, path = r - 1, q - 1, [(r - 1, q - 1)]
    while i > 0 or j > 0:
        a, b, l = d[i, j], d[i, j + 1], d[i + 1, j]  # noqa: E741
        if a <= b and a <= l:
            i, j = i - 1, j - 1
        elif b <= a and b <= l:
            i -= 1
        else:
            j -= 1
        path.append((i, j))
    p = np.array(path[::-1])
    return x[p[:, 0]], y[p[:, 1]]


@pytest.mark.parametrize("costs", [Costs(alpha=0.0), Costs.of_weights([1, 1.4, 2, 1.2], 0.35), Costs.of_weights([1, 1.1, 1.2, 1.3], 1.0, "cityblock", False)])
def test_warp_equals_the_plain_recursion(costs):
    r = np.random.default_rng(1)
    make = lambda: np.minimum(r.integers(0, 9, r.integers(1, 12)) / 2, 4)
    xs, ys = [make() for _ in range(40)], [make() for _ in range(40)]
    got = warp(xs, ys, costs)
    for k, (x, y) in enumerate(zip(xs, ys)):
        px, py = slow_warp(x, y, costs)
        assert got.x[k] == px.tolist() and got.y[k] == py.tolist()
        assert got.distance[k] == pytest.approx(sequence_distance(px, py, costs))
    assert warp([np.zeros(3)], [np.zeros(2)], Costs()).distance == [0.0]


def test_aligned_table(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 2.0], [0.0, 1.0, 2.0]), (2, [], [1.0]), (3, None, [1.0])], "i int, a array<double>, b array<double>")
    got = {r["i"]: r for r in alignment.aligned(df, "a", "b", Costs(alpha=0.0), paths=True).collect()}
    assert got[1]["distance"] == 0.0 and list(got[1]["path_b"]) == [0.0, 1.0, 1.0, 2.0]
    assert got[2]["distance"] is None or np.isnan(got[2]["distance"])
    again = alignment.rescored(spark.createDataFrame([([0.0, 2.0], [0.0, 1.0])], "path_a array<double>, path_b array<double>"), Costs(distance="cityblock")).first()
    assert again["distance"] == pytest.approx(1 / 8)


def test_ward_and_cut():
    r = np.random.default_rng(2)
    p = np.concatenate([r.normal(c, 0.05, (7, 2)) for c in ((0, 0), (3, 0), (0, 5))])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    linkage = clustering.ward(d)
    assert (np.diff(linkage[:, 2]) >= -1e-12).all() and linkage[-1, 3] == 21
    assert clustering.cut(linkage, 3).tolist() == [1] * 7 + [2] * 7 + [3] * 7
    peaks = np.repeat([0, 1, 2], 7)
    labels = clustering.dynamic_cut(linkage, d, peaks, lambda v: 1.0, least=3, share=0.4)
    assert len({tuple(sorted(k for k in labels if labels[k] == v)) for v in labels.values()}) == 3
    assert set(clustering.dynamic_cut(linkage, d, peaks, lambda v: 1.0, least=8).values()) == {"1"}  # a side of 7 is too small
    assert set(clustering.dynamic_cut(linkage, d, peaks, lambda v: 0.0, least=3, levels=2).values()) == {"1-l", "1-r"}
    assert set(clustering.dynamic_cut(linkage, d, np.zeros(21), lambda v: float("nan"), least=3, share=0.7).values()) == {"1-l", "1-r"}  # nothing is mixed, large or skewed
    assert len(clustering.tree_paths(linkage)) == 21 and clustering.mean_parent_height(linkage, clustering.cut(linkage, 3)) > 1


def test_membership_barycenters_and_merging(spark):
    items = spark.createDataFrame([(1, "a", [0.0, 1.0, 1.0, 2.0]), (2, "a", [0.0, 1.0, 2.0]), (3, "b", [3.0, 3.0])], "id long, label string, values array<double>")
    centers = spark.createDataFrame([("a", [0.0, 1.0, 2.0]), ("b", [3.0, 3.0])], "label string, values array<double>")
    assert {r["id"]: r["label"] for r in clustering.membership(items, centers, Costs(alpha=0.0)).collect()} == {1: "a", 2: "a", 3: "b"}
    got = {r["label"]: list(r["values"]) for r in clustering.barycenters(items.select("label", "values"), centers, Costs(alpha=0.0)).collect()}
    assert got == {"a": [0.0, 1.0, 2.0], "b": [3.0, 3.0]}
    three = spark.createDataFrame([("a", 2, [0.0, 1.0, 2.0]), ("b", 1, [0.0, 1.0, 1.0, 2.0]), ("c", 1, [4.0, 4.0]), ("d", 1, []), ("e", 1, None)], "label string, size int, values array<double>")
    left, merges = clustering.merged_centers(three, Costs(alpha=0.0), 0.1)
    assert {r["label"]: (r["size"], r["values"]) for r in left.collect()} == {"a": (3, [0.0, 1.0, 2.0]), "c": (1, [4.0, 4.0]), "d": (1, []), "e": (1, None)}
    assert [(r["round"], r["a"], r["b"]) for r in merges.collect()] == [(1, "a", "b")]


def test_merging_in_rounds(spark):
    """Against loops: pairs that are nearest to each other merge in a round, by sizes, at the lesser label's length, under both limits."""
    costs, r = Costs.of_weights([1.0, 1.2, 1.5, 1.3], 0.35), np.random.default_rng(6)
    held = {k: (int(r.integers(1, 9)), r.integers(0, 4, r.integers(3, 9)).astype(float)) for k in range(12)}
    df = spark.createDataFrame([(k, n, v.tolist()) for k, (n, v) in held.items()], "label int, size int, values array<double>")
    left, merges = clustering.merged_centers(df, costs, 0.6, 40.0)
    want, turn = [], 0
    while True:
        turn += 1
        d = {}
        for a in held:
            for b in held:
                if a < b:
                    got = alignment.warp([held[a][1]], [held[b][1]], costs)
                    e = got.extension_x[0] + got.extension_y[0]
                    x = got.distance[0] + e / len(got.x[0])
                    if e <= 40 and x <= 0.6:
                        d[a, b] = d[b, a] = x
        near = {a: min((x, b) for (p, b), x in d.items() if p == a) for a in {p for p, _ in d}}
        pairs = [(a, b, x) for a, (x, b) in near.items() if a < b and near[b][1] == a]
        if not pairs:
            break
        for a, b, x in pairs:
            got = alignment.warp([held[a][1]], [held[b][1]], costs)
            (na, va), (nb, _) = held[a], held.pop(b)
            m = (na * np.array(got.x[0]) + nb * np.array(got.y[0])) / (na + nb)
            held[a] = (na + nb, np.interp(np.linspace(0, len(m) - 1, len(va)), np.arange(len(m)), m))
            want.append((turn, a, b, round(x, 9)))
    assert turn > 2 and sorted((x["round"], x["a"], x["b"], round(x["distance"], 9)) for x in merges.collect()) == sorted(want)
    got = {x["label"]: (x["size"], x["values"]) for x in left.collect()}
    assert set(got) == set(held) and all(got[k][0] == n and np.allclose(got[k][1], v) for k, (n, v) in held.items())


def test_barycenters_follow_the_kernels_path(spark):
    """One round from a center with plateaus, with penalties: what each of its places meets, by the path itself."""
    costs, r = Costs.of_weights([1.0, 1.2, 1.5, 1.3], 0.35), np.random.default_rng(5)
    items = [r.integers(0, 4, r.integers(3, 9)).astype(float) for _ in range(40)]
    center = np.array([0.0, 0.0, 1.0, 1.0, 1.0, 3.0, 3.0, 0.0])
    met = [[] for _ in center]
    for x in items:
        got = alignment.warp([center], [x], costs)
        assert np.array_equal(center[got.at_x[0]], got.x[0]) and set(np.diff(got.at_x[0])) <= {0, 1}
        for p, v in zip(got.at_x[0], got.y[0]):
            met[p].append(v)
    df = spark.createDataFrame([("a", x.tolist()) for x in items], "label string, values array<double>")
    seeds = spark.createDataFrame([("a", center.tolist())], "label string, values array<double>")
    got = clustering.barycenters(df, seeds, costs, rounds=1).first()["values"]
    assert got == pytest.approx([np.mean(v) for v in met])
    with pytest.raises(ValueError):
        clustering.barycenters(df, spark.range(clustering.MOST + 1).selectExpr("cast(id as string) label", "array(0D) values"), costs)


def test_names_of_clusters_and_centers(spark):
    stages = [(1, 0, 1), (1, 0, 2), (1, 3, 0), (2, -2, 3), (2, 0, 3), (2, 9, 0), (2, 7, 3), (3, 1, 1), (3, 2, 3), (4, 0, 4), (4, 1, 4), (5, 0, 2), (5, 1, 0), (6, 0, 2), (6, 4, 0)]
    df = spark.createDataFrame(stages, "id int, day int, stage int")
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")], "id int, label string")
    peaks = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (4, 4), (5, 2), (6, 2)], "id int, peak int")
    got = {r["label"]: r["name"] for r in clustering.categories(df, labels, peaks).collect()}
    assert got == {"a": "2-Im", "b": "3-St", "c": "3-Ws", "d": "3D-St", "e": "2-Im-1", "f": "2-Im-2"}
    centers = spark.createDataFrame([(1, [0.0, 2.0, 0.1]), (2, [2.0, 3.6, 0.2]), (3, [2.0, 1.0]), (4, [0.0, 1.0]), (5, []), (6, [2.5])], "label int, values array<double>")
    plain = {r["label"]: r["name"] for r in clustering.center_categories(centers).collect()}
    assert plain == {1: "2-St", 2: "3D-Im", 3: "2-Im", 4: "1-Ws", 5: None, 6: "2-St"}
    fine = {r["label"]: r["name"] for r in clustering.center_categories(centers, transient=True, stratified=True).collect()}
    assert fine == {1: "2-Tr", 2: "3D-compIm", 3: "2-partIm", 4: "1-Ws", 5: None, 6: "2-St"}


def test_simulated_shapes_are_found_again(spark):
    s = simulation.simulated(spark, 3)
    assert s.count() == 3 * s.select("label").distinct().count() and s.first()["values"].__len__() == 56
    a, b = s.collect(), simulation.simulated(spark, 3).collect()
    assert a == b
    assert simulation.subsets(s, ["0-1-2-0"], 2).count() == 2


def test_quantiles():
    assert evaluation.t_quantile(0.95, 10) == pytest.approx(2.228139, abs=1e-5)
    assert evaluation.t_two_sided(2.0, 5) == pytest.approx(0.101939, abs=1e-5)
    assert evaluation.chi2_above(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert evaluation.chi2_above(20.0, 10) == pytest.approx(0.029253, abs=1e-5)


def test_models(spark):
    r = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(c), int(a + 0.3 * b + r.normal(0, 0.2) > 0)) for i, (a, b, c) in enumerate(r.normal(size=(240, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    scored = modelling.cross_scored(df, ["a", "b", "c"], "id", "y", "log", 3)
    assert scored.count() == 240
    assert evaluation.auc(scored, "y", "p").first()["auc"] > 0.9
    model = modelling.fitted(df, ["a", "b", "c"], "y")
    assert [r["feature"] for r in modelling.odds(model, ["a", "b", "c"], spark).orderBy("rank").collect()][0] == "a"
    assert modelling.selected(df, ["a", "b", "c"], "y", "rfe", 1) == ["a"]
    assert modelling.selected(df, ["a", "b", "c"], "y", "univariate", 1) == ["a"]
    even = modelling.balanced(df, "id", "y").groupBy("y").count().collect()
    assert even[0]["count"] == even[1]["count"]
    more = modelling.balanced(df, "id", "y", "rand_over").groupBy("y").count().collect()
    assert more[0]["count"] == more[1]["count"] >= 120
