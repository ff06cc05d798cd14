"""Extraction beside the corpus queries: single files, repositories on disk, the stream."""

from __future__ import annotations

import subprocess
from pathlib import Path

import pytest

from orrery.cli import extracted
from orrery.emit import graph_json, gravity_json, gravity_report, write_tables
from orrery.operators.contracts import contracts
from orrery.plans import corpora
from orrery.sources.files import fact_table, provenance, world_name
from orrery.sources.parsers import python_facts


def keys(spark, *sources):
    files = spark.createDataFrame([("w", 0, rel, text) for rel, text in sources], corpora.FILES)
    return {(r["rel"], r["kind"], r["key"]) for r in contracts(fact_table(files)).collect()}


def test_yaml(spark):
    spec = "openapi: 3.0.0\npaths:\n  /tides/{port}: {get: {}}\n"
    cases = {
        "a/openapi.yaml": spec + "---\npaths: {/later: {put: {}}}\n",
        "b/openapi.yaml": spec + "---\n[broken\n",
        "c/openapi.yaml": spec + "  /tides/{port}: {put: {}}\n",
        "d/openapi.yaml": spec + "info: {built: 2024-02-31, by: !team tide}\n",
        "e/openapi.yaml": spec + "x: [\n",
        "f/openapi.yaml": "openapi: 3.0.0\npaths: [1, 2]\n",
        "g/openapi.yaml": "",
        "h/values.yaml": "when: 2024-02-31\nTIDE_HOST: !secret tide\n? [a, b]\n: c\n",
        "i/values.yaml": "TIDE_HOST: 2024-02-31\n",
        "j/values-x.yml": "A_HOST: moon\nB_HOST: moon\n---\nC_HOST: sun\n",
        "k/Chart.yaml": "- not\n- a map\n",
        "l/Chart.yaml": "name: [\n",
    }
    got = keys(spark, *cases.items())
    endpoint = "GET /tides/{}"
    assert got == {*[(f"{x}/openapi.yaml", "http_endpoint", endpoint) for x in "abd"], ("j/values-x.yml", "service_ref", "moon"), ("i/values.yaml", "service_ref", "2024-02-31"), ("k/Chart.yaml", "service", "k")}


def test_tests_and_generated_files_give_no_contracts(spark):
    go = corpora.SOURCES["dome/wire.go"]
    rels = ["dome/wire_test.go", "src/test/wire.go", "dome/wire.pb.go", "vendor/wire.go", "a/.hidden/wire.go"]
    assert keys(spark, *[(r, go) for r in rels]) == set()


def test_broken_python_keeps_what_parses():
    lines = ["def first():\n    os.getenv('A')", *[f"bad line {k} ((" for k in range(400)], 's = """\ndef inside(): pass\n"""', "@app.get('/moons')\ndef second(): pass", "class Third:\n    def whole(self): os.getenv('B')\n    def half(self: pass"]
    got = list(python_facts("\n".join(lines)))
    assert [f["name"] for f in got if f["fact"] == "decl"] == ["first", "second", "Third", "Third.whole"]
    assert [f["args"][0]["lit"] for f in got if f["fact"] == "call"] == ["A", "/moons", "/moons", "B"]


@pytest.fixture
def repos(tmp_path):
    for world, sources in corpora.REPOS.items():
        for rel, text in sources.items():
            at = tmp_path / world / rel
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    return [(w, str(tmp_path / w)) for w in corpora.REPOS]


def test_end_to_end(spark, repos, tmp_path):
    graph = extracted(spark, repos)
    assert {tuple(r) for r in graph.nodes.select("id", "kind").collect()} == set(corpora.NODES)
    assert {tuple(r) for r in graph.edges.collect()} == set(corpora.EDGES)
    assert {tuple(r) for r in graph.cross_edges.collect()} == set(corpora.CROSS)
    assert '"worlds": [\n    "relay"' in graph_json(graph)
    assert '"pair_edges": 1' in gravity_json(gravity_report(graph))
    write_tables(graph, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == graph.nodes.count()


def test_split_on_directories(spark, repos):
    (Path(repos[0][1]) / "cmd/empty").mkdir()
    graph = extracted(spark, repos, split=True)
    assert {r[0] for r in graph.worlds.collect()} == {"relay", "pier", "mast"}


def test_missing_repository(spark, tmp_path):
    with pytest.raises(OSError):
        extracted(spark, [("w", str(tmp_path / "nowhere"))])


def test_provenance_and_world_name(tmp_path):
    assert provenance(str(tmp_path)) == ("", "")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-b", "trunk")
    git("commit", "--allow-empty", "-m", "x")
    git("remote", "add", "origin", "https://example.com/r.git")
    assert provenance(str(tmp_path)) == ("https://example.com/r.git", "trunk")
    assert world_name("/x/y/") == "y"


def test_stream(spark, tmp_path):
    from orrery.streaming.incremental import start

    go = ("dome/wire.go", corpora.SOURCES["dome/wire.go"])
    spark.createDataFrame([("w", 0, *go)], corpora.FILES).write.parquet(str(tmp_path / "in"))
    start(spark.readStream.schema(corpora.FILES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {(r["rel"], r["kind"], r["key"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == keys(spark, go)
