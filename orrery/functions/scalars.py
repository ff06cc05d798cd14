"""Normalizers and predicates as Column expressions that Catalyst compiles.

Patterns end with ``\\z`` and spell out word boundaries and white space, because
Java's ``$``, ``\\b`` and ``\\s`` mean other sets than those wanted here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery import model

SENTINEL = "\0VAR\0"
#: Patterns that must match alike for equal keys. When a literal is SQL, and which tokens are its tables.
SQL_GATE = r"(?i)(?<![A-Za-z0-9_])(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|REPLACE|MERGE)(?![A-Za-z0-9_])"
SQL_TABLE = "(?i)(?<![A-Za-z0-9_])(?:FROM|JOIN|INTO|UPDATE|TABLE)[\\t\\n\\f\\r ]+[\"'`]?([A-Za-z_][A-Za-z0-9_.]*)"
OPENAPI_LINE = r"""(?m)^[ \t]*["']?(openapi|swagger)["']?[ \t]*:[ \t]*["']?[23]"""
SERVICE_KEY = r"(?i)_(HOST|ADDR|ADDRESS|URL|ENDPOINT|UPSTREAM|SVC)\z"


def _or(value: Column, instead: str) -> Column:
    return F.when((value == "") | value.isNull(), F.lit(instead)).otherwise(value)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+\z", "")


#: Path parameters, numbers, version prefixes.
PARAMETER = r"\{[^/}]+\}|\$\{[^/}]+\}|:[A-Za-z_][A-Za-z0-9_]*"
NUMBER, VERSION = "/[0-9]+", r"^/(api|v[0-9]+)(/|\z)"
#: Names of services in addresses; gRPC names of clients, servers and mocks.
SERVICE_NAME = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?\z"
GO_CLIENT, GO_SERVER, PYTHON_STUB, PYTHON_REGISTRAR, NEW_CLIENT = r"^New(.+)Client\z", r"^Register(.+)Server\z", r"^(.+)Stub\z", r"^add_(.+)Servicer_to_server\z", r"^(.+)Client\z"
MOCKED = "^(Mock|Fake|Stub|Spy)"


def http_key(method: Column, path: Column) -> Column:
    """``METHOD /path`` with parameters, numbers and version prefixes normalized."""
    p = _or(F.regexp_replace(_or(path, "/"), r"(?s)\?.*\z", ""), "/")
    p = F.regexp_replace(p, PARAMETER, "{}")
    p = F.regexp_replace(p, NUMBER, "/{}")
    p = F.regexp_replace(p, VERSION, "/")
    return F.concat(_or(F.upper(method), "GET"), F.lit(" "), F.regexp_replace(p, "//+", "/"))


def url_path(raw: Column) -> Column:
    """Path of a literal URL: of http(s) URLs the decoded path, of paths themselves, else empty."""
    path = F.regexp_extract(raw, r"^https?://[^/?#]*([^?#]*)", 1)
    authority = F.regexp_extract(raw, "^https?://([^/?#]*)", 1)
    user = F.regexp_extract(authority, r"(?s)^(.*)@", 1)
    at = F.regexp_replace(authority, r"(?s)^.*@", "")
    port = at.rlike(r"^[^\[].*:[^:]*[^0-9:][^:]*\z|^:[^:]*[^0-9:][^:]*\z|^\[(?!.*\](:[0-9]*)?\z)")
    bad = path.rlike("%(?![0-9A-Fa-f]{2})") | port | user.rlike(r"[^A-Za-z0-9._:~!$&'()*+,;=%@-]") | at.rlike(r"[ {}|\\^`]") | raw.rlike(r"[\x00-\x1F\x7F]")
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit(""))).otherwise(path)
    of_url = F.when(bad, F.lit("")).otherwise(_or(decoded, "/"))
    return F.when(raw.rlike("^https?://"), of_url).when(F.startswith(raw, F.lit("/")), raw).otherwise(F.lit(""))


def template_path(raw: Column) -> Column:
    """Path of a URL rebuilt from pieces, with ``{}`` for what isn't literal; null if nothing literal is left."""
    rest = F.when(raw.contains("://"), F.regexp_extract(raw, r"(?s)://(.*)\z", 1)).otherwise(raw)
    p = F.regexp_extract(rest, r"(?s)(/.*)\z", 1)
    p = F.regexp_replace(p, SENTINEL, "{}")
    p = F.regexp_replace(F.regexp_replace(p, r"(\{\})+", "{}"), "//+", "/")
    p = F.regexp_replace(p, r"(?<=[^/])\{\}\z", "")
    literal = F.exists(F.split(p, "/"), lambda s: ~s.isin("", "{}"))
    return F.when(F.startswith(p, F.lit("/")) & literal, p)


def normalized_service(name: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(name)), r"-headless\z", "")


def service_of(value: Column) -> Column:
    """Service that an address names; null for none."""
    v = trimmed(value)
    v = F.when(v.contains("://"), F.regexp_extract(v, r"(?s)://(.*)\z", 1)).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)[/:].*\z", ""), r"(?s)\..*\z", "")
    v = normalized_service(v)
    return F.when(v.rlike(SERVICE_NAME) & ~v.rlike(r"^[0-9]+\z"), v)


def topic_key(topic: Column) -> Column:
    return F.lower(topic)


def required_module(entry: Column) -> Column:
    """Module that a go.mod requirement names; empty for indirect or malformed ones."""
    fields = F.split(trimmed(F.regexp_replace(entry, r"(?s)//.*\z", "")), r"[\t\n\x0B\f\r ]+")
    ok = ~entry.contains("// indirect") & (F.size(fields) >= 2) & F.startswith(F.try_element_at(fields, F.lit(2)), F.lit("v"))
    return F.when(ok, F.element_at(fields, 1)).otherwise(F.lit(""))


def joined_route(base: Column, path: Column) -> Column:
    """Two route parts; a slash goes between them where neither brings one."""
    both = F.when(base.endswith("/") | path.startswith("/"), F.concat(base, path)).otherwise(F.concat(base, F.lit("/"), path))
    return F.when(base == "", path).when(path == "", base).otherwise(both)


def aspnet_route(base: Column, path: Column) -> Column:
    """As ``joined_route``, but a path from the root stands alone."""
    return F.when(path.startswith("/"), path).otherwise(joined_route(base, path))


def request_method(text: Column) -> Column:
    """Verb that a Java request-method expression names, else GET."""
    last = F.upper(F.element_at(F.split(text, r"\."), -1))
    return F.when(last.isin("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"), last).otherwise(F.lit("GET"))


def is_csharp_interface(name: Column) -> Column:
    return name.rlike("^I[A-Z]")


def weight(protocol: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in model.WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(protocol, F.lit(""))), F.lit(1.0))


def round4(x: Column) -> Column:
    """Four digits by truncating x + 0.00005, also below zero."""
    return (x * 10000 + 0.5).cast("bigint") / F.lit(10000.0)


def rel_of(node_id: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(node_id, "::"), F.lit(2)), F.lit(""))


def sql_tables(value: Column) -> Column:
    """Lower-cased table tokens of a literal that looks like SQL, as an array."""
    found = F.transform(F.regexp_extract_all(value, F.lit(SQL_TABLE), 1), F.lower)
    return F.when((F.octet_length(value) >= 12) & value.rlike(SQL_GATE), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


# gRPC names: each gives the service, or null.


def _service(name: Column, pattern: str) -> Column:
    found = F.regexp_extract(name, pattern, 1)
    return F.when(~found.isin(*model.GRPC_NON_SERVICES), found)


def go_grpc_client(name: Column) -> Column:
    found = _service(name, GO_CLIENT)
    return F.when(~found.rlike(MOCKED), found)


def go_grpc_server(name: Column) -> Column:
    found = _service(name, GO_SERVER)
    return F.when(~found.rlike(MOCKED) & ~found.isin("Health", "ServerReflection"), found)


def python_stub(name: Column) -> Column:
    return _service(name, PYTHON_STUB)


def python_registrar(name: Column) -> Column:
    return _service(name, PYTHON_REGISTRAR)


def new_client(name: Column) -> Column:
    return _service(name, NEW_CLIENT)


def agreed_suffix(full: Column, suffix: str) -> Column:
    """X where a qualified name ends in ``X.X`` + suffix."""
    s = F.split(full, r"\.")
    outer = F.try_element_at(s, F.lit(-2))
    return F.when((F.size(s) >= 2) & (F.element_at(s, -1) == F.concat(outer, F.lit(suffix))), outer)


# Noise: keys that link nothing.


def http_noise(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^[^ ]* (.*)\z", 1).isin(*model.HTTP_NOISE)


def service_noise(key: Column) -> Column:
    return key.isin(*model.INFRA_NAMES, *model.GENERIC_NAMES)


def config_noise(key: Column) -> Column:
    return F.startswith(F.upper(key), F.lit("OTEL_")) | F.upper(key).isin(*model.CONFIG_NOISE)


def table_noise(key: Column) -> Column:
    first = F.substring_index(key, ".", 1)
    return (F.octet_length(key) <= 2) | key.rlike("^(pg_|sqlite_)") | key.isin(*model.TABLE_NOISE) | first.isin(*model.TABLE_NOISE)


def is_noise(kind: Column, key: Column) -> Column:
    """Whether ``key`` of a node of ``kind`` may not link worlds."""
    return (
        F.when(kind.isin("http_endpoint", "http_client"), http_noise(key))
        .when(kind.isin("service", "service_ref"), service_noise(key))
        .when(kind == "config_key", config_noise(key))
        .when(kind == "data_entity", table_noise(key))
        .otherwise(F.lit(False))
    )


# Paths of files, relative to the repository.


def base_name(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def is_pruned_dir(rel: Column) -> Column:
    parts = F.split(rel, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(dirs, lambda s: s.isin(*model.SKIPPED_DIRS) | (s.startswith(".") & (F.length(s) > 1) & (s != ".github")))


def is_generated(rel: Column) -> Column:
    pattern = "|".join(x.replace(".", r"\.") for x in model.GENERATED)
    return base_name(rel).rlike(rf"({pattern})\z")


def language(rel: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in model.LANGUAGES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(base_name(rel), r"\.[^.]*\z", 0)))


def is_test_file(rel: Column) -> Column:
    base = F.lower(base_name(rel))
    segment = F.arrays_overlap(F.split(rel, "/"), F.array(*[F.lit(d) for d in model.TEST_DIRS]))
    tree = F.concat(F.lit("/"), rel).rlike(r"/src/tests?(/|\z)")
    named = base.rlike(r"(_test\.go|_test\.py|\.(test|spec)\.(ts|tsx|js|jsx))\z") | base.rlike(r"^test_.*\.py\z") | (base == "conftest.py")
    return segment | tree | named | base_name(rel).rlike(r"Tests?\.(java|cs)\z")


def is_openapi(rel: Column, content: Column) -> Column:
    base = F.lower(base_name(rel))
    return base.rlike(r"\.(yaml|yml|json)\z") & (base.rlike("^(openapi|swagger)") | content.rlike(OPENAPI_LINE))


def route(rel: Column, content: Column) -> Column:
    """How a file is read: the first that fits."""
    base = F.lower(base_name(rel))
    return (
        F.when(is_generated(rel), "skip")
        .when(is_openapi(rel, content), "openapi")
        .when(base.isin("chart.yaml", "chart.yml"), "helm_chart")
        .when(base.rlike(r"^values(-.*)?\.(yaml|yml)\z"), "helm_values")
        .when(base_name(rel) == "go.mod", "gomod")
        .when(language(rel).isNotNull(), "code")
        .otherwise("skip")
    )
