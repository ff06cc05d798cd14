from __future__ import annotations

from itertools import combinations

from orrery import model
from orrery.operators import gravity, resolve, split


def nodes(spark, rows):
    return spark.createDataFrame([(f"{w}::{k}::{n}" if len(r) == 3 else r[3], w, k, n) for r in rows for w, k, n in [r[:3]]], "id string, world string, kind string, name string")


def test_directional(spark):
    got = resolve.directional(nodes(spark, [
        ("a", "http_endpoint", "GET /users"), ("b", "http_client", "GET /users"), ("a", "http_client", "GET /users"), ("b", "http_endpoint", "GET /healthz"),
        ("c", "http_client", "GET /healthz"), ("a", "topic_producer", "t"), ("b", "topic_consumer", "t"), ("a", "service", "api"), ("b", "service_ref", "api"), ("a", "package_publish", "p"), ("b", "package_dep", "p"),
    ]))
    assert {tuple(r) for r in got.collect()} == {
        ("b::http_client::GET /users", "a::http_endpoint::GET /users", "http_call", "http", "GET /users", 0.85),
        ("a::topic_producer::t", "b::topic_consumer::t", "publishes_to", "pubsub", "t", 0.8),
        ("b::package_dep::p", "a::package_publish::p", "depends_on", "package", "p", 0.95),
    }


def test_symmetric_caps_and_representatives(spark):
    rows = [(w, "config_key", "TOKEN", f"{w}::cfg::TOKEN-{i}") for w in "abc" for i in (2, 1)]
    rows += [(f"w{i}", "config_key", "WIDE") for i in range(8)] + [("a", "config_key", "PORT"), ("b", "config_key", "PORT"), ("a", "config_key", "ONE")]
    got = resolve.symmetric(nodes(spark, rows)).collect()
    assert {(r["src"], r["dst"]) for r in got} == {(f"{x}::cfg::TOKEN-1", f"{y}::cfg::TOKEN-1") for x, y in combinations("abc", 2)}
    assert {(r["rel"], r["protocol"], r["confidence"]) for r in got} == {("reads_config", "config", 0.7)}


def test_unique_references(spark):
    symbols = spark.createDataFrame([("f1", "w", "function", "f"), ("g1", "w", "function", "g"), ("g2", "w", "method", "g"), ("C", "w", "class", "f")], "id string, world string, kind string, lookup string")
    refs = spark.createDataFrame([("w", "x", "f", "calls"), ("w", "x", "f", "calls"), ("w", "x", "g", "calls"), ("w", "f1", "f", "calls"), ("w", "x", "f", "inherits"), ("v", "x", "f", "calls")], "world string, src string, target string, rel string")
    assert sorted(map(tuple, resolve.unique_references(symbols, refs).collect())) == [("x", "C", "inherits"), ("x", "f1", "calls")]


def report(spark, pairs, worlds=""):
    names = sorted({w for p in pairs for w in p[:2]} | set(worlds))
    n = spark.createDataFrame([(w, w) for w in names], "id string, world string")
    e = spark.createDataFrame([(a, b, "http") for a, b in pairs], "src string, dst string, protocol string")
    return gravity.report(n, e).first().asDict(recursive=True)


def test_two_triangles(spark):
    got = report(spark, [*combinations("abc", 2), *combinations("def", 2), ("c", "d")])
    assert got["galaxies"] == [["a", "b", "c"], ["d", "e", "f"]]
    assert (got["modularity"], got["pair_edges"], got["density"], got["black_hole"]) == (0.3571, 7, 0.4667, False)
    assert got["worlds"][0] == {"world": "c", "mass": 3.0}


def test_complete_graph_and_star(spark):
    k6 = report(spark, list(combinations("abcdef", 2)))
    assert (len(k6["galaxies"]), k6["modularity"], k6["density"], k6["black_hole"]) == (1, 0.0, 1.0, True)
    star = report(spark, [("h", x) for x in "abc"])
    assert (star["worlds"][0], star["modularity"], star["density"], star["black_hole"]) == ({"world": "h", "mass": 3.0}, 0.0, 0.5, True)


def test_no_edges(spark):
    got = report(spark, [], "ab")
    assert (got["modularity"], got["pair_edges"], got["density"], got["black_hole"]) == (0.0, 0, 0.0, False)
    assert got["galaxies"] == [["a"], ["b"]]


def test_split(spark):
    n = spark.createDataFrame([(f"r::{x}", "r", "file", x) for x in ("cmd/foo/main.go", "cmd/server/a.go", "charts/foo/Chart.yaml", "internal/x.go", "cmd/bar/b.go")], "id string, world string, kind string, name string")
    e = spark.createDataFrame([("r::cmd/foo/main.go", "r::internal/x.go", "calls")], model.EDGES)
    cross = spark.createDataFrame([], model.CROSS_EDGES)
    dirs = spark.createDataFrame([("r", d) for d in ("cmd", "cmd/foo", "cmd/bar", "cmd/server", "charts", "charts/foo", "internal")], "world string, dir string")
    out, edges, _ = split.split_worlds(n, e, cross, dirs)
    assert {(r["id"], r["world"]) for r in out.collect()} == {("foo::cmd/foo/main.go", "foo"), ("r::cmd/server/a.go", "r"), ("foo::charts/foo/Chart.yaml", "foo"), ("r::internal/x.go", "r"), ("r::cmd/bar/b.go", "r")}
    assert [tuple(r) for r in edges.collect()] == [("foo::cmd/foo/main.go", "r::internal/x.go", "calls")]
    ungated = dirs.where("dir not like 'charts%'")
    assert {r[0] for r in split.split_worlds(n, e, cross, ungated)[0].select("world").collect()} == {"foo", "bar", "r"}
    assert split.split_worlds(n, e, cross, dirs.limit(0))[0].exceptAll(n).count() == 0


def test_split_roots_at_many_depths(spark):
    dirs = ["/".join(["d"] * k + [f"s{k}"]) for k in range(70)]
    n = spark.createDataFrame([(f"r::{d}/a.go", "r", "file", d) for d in dirs], "id string, world string, kind string, name string")
    roots = spark.createDataFrame([("r", d, f"s{k}") for k, d in enumerate(dirs)], "world string, dir string, name string")
    assert {r["sub"] for r in split.renamed(n, roots).collect()} == {f"s{k}" for k in range(70)}


def test_local_moves_against_the_rules_word_by_word():
    import random

    import numpy as np

    def plain(n, w):
        degree = [sum(row) for row in w]
        total, label = sum(degree), list(range(n))
        for _ in range(100 if total else 0):
            before = list(label)
            for i in range(n):
                choice, most = i, 0.0
                for c in sorted({label[i], *(label[j] for j in range(n) if w[i][j])}):
                    pull = sum(w[i][j] for j in range(n) if j != i and label[j] == c)
                    gain = pull - sum(degree[j] for j in range(n) if j != i and label[j] == c) * degree[i] / total
                    if gain > most or (gain == most and c < choice):
                        choice, most = c, gain
                label[i] = choice
            if label == before:
                break
        return label

    for seed in range(400):
        draw = random.Random(seed)
        n = draw.randint(1, 10)
        w = [[0.0] * n for _ in range(n)]
        links = [(i, j, draw.randint(1, 8) / 2) for i, j in combinations(range(n), 2) if draw.random() < draw.choice([0.2, 0.6, 1])]
        for i, j, x in links:
            w[i][j] = w[j][i] = x
        a, b, x = np.array(links, float).reshape(-1, 3).T
        assert gravity.local_moves([str(i) for i in range(n)], a.astype(int), b.astype(int), x).tolist() == plain(n, w)
