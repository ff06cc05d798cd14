from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars as S

V = S.SENTINEL


def values(spark, rows, columns, expr):
    return [r[0] for r in spark.createDataFrame(rows, columns).select(expr).collect()]


def test_http_key(spark):
    rows = [("GET", p) for p in ("/users/123", "/users/{id}", "/users/:id", "/users/${id}", "/api/users/55", "/v1/users/55", "/users/123?expand=true")]
    assert set(values(spark, rows, "m string, p string", S.http_key(F.col("m"), F.col("p")))) == {"GET /users/{}"}
    rows = [("get", "/api/v1/x"), ("", ""), ("post", "//api/x"), ("GET", "/2fa/x"), ("GET", "/a:verb"), ("GET", "/api"), ("GET", "/v2/"), ("GET", "?x"), ("GET", "/api\n")]
    want = ["GET /v1/x", "GET /", "POST /api/x", "GET /{}fa/x", "GET /a{}", "GET /", "GET /", "GET /", "GET /api\n"]
    assert values(spark, rows, "m string, p string", S.http_key(F.col("m"), F.col("p"))) == want


def test_template_path(spark):
    cases = {
        f"{V}/api/v1/svc/things/{V}": "/api/v1/svc/things/{}", f"{V}/users/{V}": "/users/{}", f"{V}/orders": "/orders", "http://h/x": "/x",
        f"{V}/api/v1/priceservice/prices/{V}/{V}": "/api/v1/priceservice/prices/{}/{}", f"/x/{V}{V}": "/x/{}", f"/stationservice{V}": "/stationservice",
        f"/search?q={V}": "/search?q=", f"{V}{V}": None, f"{V}/{V}": None, "http://host": None, f"{V}host{V}": None,
    }
    assert values(spark, [(k,) for k in cases], "raw string", S.template_path(F.col("raw"))) == list(cases.values())


@pytest.mark.parametrize(("raw", "want"), [("http://h/users/{id}", "/users/{id}"), ("https://h", "/"), ("/a?b", "/a?b"), ("x/y", ""), ("http://h/a%20b+c", "/a b+c"), ("http://h/%zz", "")])
def test_url_path(spark, raw, want):
    assert values(spark, [(raw,)], "raw string", S.url_path(F.col("raw"))) == [want]


def test_service_of(spark):
    cases = {"auth:8080": "auth", "http://device.ns.svc.cluster.local:80/x": "device", " Postgres ": "postgres", "10.0.0.1": None, "a_b": None, "x-headless.ns": "x", "": None, "-a": None}
    assert values(spark, [(k,) for k in cases], "v string", S.service_of(F.col("v"))) == list(cases.values())


def test_required_module(spark):
    cases = {"github.com/a/b v1.2.3": "github.com/a/b", "github.com/a/b v1 // indirect": "", "github.com/a/b v1 // why": "github.com/a/b", "github.com/a/b": "", "\tx v0": "x", "": "", "x latest": ""}
    assert values(spark, [(k,) for k in cases], "v string", S.required_module(F.col("v"))) == list(cases.values())


def test_round4_truncates(spark):
    assert values(spark, [(-0.0118879,), (0.35714,), (0.00005,)], "x double", S.round4(F.col("x"))) == [-0.0118, 0.3571, 0.0001]


def test_is_test_file(spark):
    yes = ["a_test.go", "x/testdata/a.go", "src/test/A.java", "src/tests/b.py", "__mocks__/a.ts", "test_a.py", "a_test.py", "conftest.py", "a.spec.tsx", "A.TEST.js", "FooTest.java", "FooTests.cs"]
    no = ["latest.py", "Latest.java", "Contest.cs", "test.go", "mytest_a.py", "src/testing/a.go", "a.test.py", "footest.java", "tests/a.go"]
    assert values(spark, [(x,) for x in yes + no], "rel string", S.is_test_file(F.col("rel"))) == [True] * len(yes) + [False] * len(no)


def test_sql_tables(spark):
    cases = {
        "SELECT * FROM orders o JOIN `order_items`": ["orders", "order_items"], "select from here, says the prose": ["here"], "FROM x": [],
        "CREATE TABLE IF NOT EXISTS foo": ["if"], "insert into a.B values": ["a.b"], "no statement from there": [],
    }
    assert values(spark, [(k,) for k in cases], "v string", S.sql_tables(F.col("v"))) == list(cases.values())


def test_grpc_names(spark):
    rows = [("NewAuthClient",), ("NewMockAuthClient",), ("NewMockingbirdClient",), ("NewHTTPClient",), ("NewCamcomPublicServiceClient",)]
    assert values(spark, rows, "n string", S.go_grpc_client(F.col("n"))) == ["Auth", None, None, None, "CamcomPublicService"]
    assert values(spark, [("Greeter.GreeterBase",), ("a.Greeter.GreeterBase",), ("GreeterBase",), ("X.GreeterBase",)], "n string", S.agreed_suffix(F.col("n"), "Base")) == ["Greeter", "Greeter", None, None]


def test_noise(spark):
    rows = [("http_endpoint", "GET /healthz"), ("http_endpoint", "GET /users"), ("service_ref", "api"), ("config_key", "otel_x"), ("config_key", "port"), ("config_key", "DATABASE_URL"), ("data_entity", "pg_x"), ("data_entity", "information_schema.t"), ("data_entity", "orders"), ("topic_producer", "orders")]
    assert values(spark, rows, "k string, n string", S.is_noise(F.col("k"), F.col("n"))) == [True, False, True, True, True, False, True, True, False, False]
