"""Producer and consumer keys from syntax facts: rules as Column expressions.

A rule gives a candidate (``CANDIDATE``): a kind with the raw method, path, URL or
key that it found. Rules are chosen by fact and language, and one explode yields all
candidates of a fact in a narrow pass, without a shuffle or a UDF. The normalizers
come after it, once each: a projection for paths, then one for keys and metadata, so
that the plan holds no rule's text more than once. The verb and name tables below
are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as S

URL = "struct<kind:string,lit:string,raw:string,has_lit:boolean,text:string,items:array<string>>"
FIELDS = {"kind": "string", "method": "string", "path": "string", "url": URL, "key": "string", "metadata": "map<string,string>"}
CANDIDATE = f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"
GO_METHODS = {v: m for m in "GET POST PUT DELETE PATCH HEAD OPTIONS CONNECT TRACE".split() for v in (m, m.capitalize())}
GO_CLIENT = {"Get": "GET", "Post": "POST", "Head": "HEAD", "PostForm": "POST"}
GO_CONSUME = "Subscribe QueueSubscribe SubscribeSync ChanSubscribe ChanQueueSubscribe ConsumePartition".split()
LOWER = {v: v.upper() for v in "get post put delete patch head options".split()}
JAVA_ROUTES = {f"{v}Mapping": v.upper() for v in "Get Post Put Delete Patch".split()}
JAVA_CLIENT = {
    "getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST",
    "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH",
}
CSHARP_MAP = {f"Map{v}": v.upper() for v in "Get Post Put Delete Patch".split()}
CSHARP_CLIENT = {
    "GetAsync": "GET", "PostAsync": "POST", "PutAsync": "PUT", "DeleteAsync": "DELETE", "PatchAsync": "PATCH", "GetStringAsync": "GET",
    "GetByteArrayAsync": "GET", "GetStreamAsync": "GET", "GetFromJsonAsync": "GET", "PostAsJsonAsync": "POST", "PutAsJsonAsync": "PUT",
}


def _cols() -> tuple[Column, ...]:
    """The fields that most rules read."""
    return tuple(F.col(c) for c in ("name", "form", "operand", "operand_last", "value"))


def _map(known: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.coalesce(key, F.lit("")))


def _arg(i: int) -> Column:
    return F.try_element_at(F.col("args"), F.lit(i + 1))


def _lit(i: int) -> Column:
    return F.when(_arg(i)["kind"] == "lit", _arg(i)["lit"])


def _meta(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _made(kind: str, **fields: Column) -> Column:
    """A candidate with the fields given."""
    return F.struct(F.lit(kind).alias("kind"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items() if f != "kind"])


def _one(when: Column, kind: str, key: Column, metadata: Column | None = None) -> Column:
    """A candidate if ``when`` holds; one whose key is null or empty is dropped in the end."""
    return F.when(when, _made(kind, key=key) if metadata is None else _made(kind, key=key, metadata=metadata))


def _client(when: Column, method: Column, url: Column) -> Column:
    return F.when(when, _made("http_client", method=method, url=url))


def _endpoint(when: Column, method: Column, path: Column) -> Column:
    return F.when(when, _made("http_endpoint", method=method, path=path))


def _topic(when: Column, kind: str, topic: Column) -> Column:
    return _one(when, kind, topic)


def _topics(when: Column, kind: str, topics: Column) -> Column:
    return F.when(when, F.transform(topics, lambda t: _made(kind, key=t)))


def _config(when: Column, env: Column) -> Column:
    return _one(when, "config_key", env)


def go_rules() -> list[Column]:
    name, form, operand, _, value = _cols()
    http = operand == "http"
    with_context = F.when(name == "NewRequestWithContext", 1).otherwise(0)
    asked = F.when(with_context == 1, _lit(1)).otherwise(_lit(0))
    url = F.when(with_context == 1, _arg(2)).otherwise(_arg(1))
    consumed = http & name.isin(*GO_CLIENT, "NewRequest", "NewRequestWithContext")
    pattern = F.try_element_at(F.filter("args", lambda a: a["kind"] == "lit"), F.lit(1))["lit"]
    verb = _map(GO_METHODS, F.upper(F.regexp_extract(pattern, "(?s)^([^ ]+) ", 1)))
    handler = name.isin("HandleFunc", "Handle")
    route_method = F.when(handler, F.coalesce(verb, F.lit("GET"))).otherwise(_map(GO_METHODS, name))
    route_path = F.when(handler & verb.isNotNull(), S.trimmed(F.regexp_extract(pattern, r"(?s)^[^ ]+ (.*)\z", 1))).otherwise(pattern)
    kafka = F.when(name.contains("Writer") | name.contains("Producer"), "p").when(name.contains("Reader") | name.contains("Consumer") | name.contains("Subscriber"), "c")
    return [
        _client((form == "call") & http & name.isin(*GO_CLIENT), _map(GO_CLIENT, name), _arg(0)),
        _client((form == "call") & http & name.isin("NewRequest", "NewRequestWithContext"), _map(GO_METHODS, F.upper(asked)), url),
        _endpoint((form == "call") & ~consumed, route_method, route_path),
        _one(form == "call", "grpc_client", S.go_grpc_client(name)),
        _one(form == "call", "grpc_service", S.go_grpc_server(name)),
        _topic((form == "call") & (name == "Publish"), "topic_producer", _lit(0)),
        _topic((form == "call") & name.isin(*GO_CONSUME), "topic_consumer", _lit(0)),
        _topic((form == "composite") & (kafka == "p"), "topic_producer", value),
        _topic((form == "composite") & (kafka == "c"), "topic_consumer", value),
        _config((form == "call") & (operand == "os") & name.isin("Getenv", "LookupEnv"), _lit(0)),
    ]


def python_rules() -> list[Column]:
    name, form, operand, _, _ = _cols()
    path = _lit(0)
    methods = F.when(F.size("methods") > 0, F.transform("methods", F.upper)).otherwise(F.array(F.lit("GET")))
    flask = F.transform(methods, lambda m: _made("http_endpoint", method=m, path=path))
    environ = operand == "os.environ"
    return [
        F.when((form == "decorator") & (name == "route"), flask),
        _endpoint((form == "decorator") & (name != "route"), _map(LOWER, name), path),
        _client((form == "call") & operand.isin("requests", "httpx", "session", "client"), _map(LOWER, name), _arg(0)),
        _one(form == "call", "grpc_client", S.python_stub(name)),
        _one((form == "call") & S.python_stub(name).isNull(), "grpc_service", S.python_registrar(name)),
        _topic((form == "call") & name.isin("publish", "send"), "topic_producer", _lit(0)),
        _topic((form == "call") & name.isin("subscribe", "KafkaConsumer"), "topic_consumer", _lit(0)),
        _topics((form == "call") & (name == "subscribe") & (_arg(0)["kind"] == "list"), "topic_consumer", _arg(0)["items"]),
        _config(environ & (form == "subscript"), name),
        _config(environ & (form == "call") & (name == "get"), _lit(0)),
        _config((form == "call") & (operand == "os") & (name == "getenv"), _lit(0)),
    ]


def ts_rules() -> list[Column]:
    name, form, operand, _, _ = _cols()
    bare = (operand == "") & name.isin("fetch", "axios")
    library = operand.isin("axios", "http")
    client_verbs = {v: m for v, m in LOWER.items() if v != "options"}
    topic = F.coalesce(_lit(0), F.try_element_at(F.when(_arg(0)["kind"] == "object", _arg(0)["items"]), F.lit(1)))
    call = form == "call"
    return [
        _client(call & bare, F.lit("GET"), _arg(0)),
        _client(call & library, _map(client_verbs, name), _arg(0)),
        _endpoint(call & ~bare & ~library, _map(LOWER | {"all": "ALL"}, name), _lit(0)),
        _one(form == "new", "grpc_client", S.new_client(name)),
        _topic(call & (name == "publish"), "topic_producer", _lit(0)),
        _topic(call & (name == "send") & (_arg(0)["kind"] == "object"), "topic_producer", F.try_element_at(_arg(0)["items"], F.lit(1))),
        _topic(call & (name == "subscribe"), "topic_consumer", topic),
        _config(form.isin("member", "subscript") & (operand == "process.env"), name),
    ]


def java_rules() -> list[Column]:
    name, form, _, last, _ = _cols()
    call = form == "call"
    named = F.try_element_at(F.filter("args", lambda a: (a["kind"] == "other") & F.startswith(a["text"], F.lit("HttpMethod."))), F.lit(1))["text"]
    method = F.when(name == "exchange", F.when(named.isNotNull(), S.request_method(named))).otherwise(_map(JAVA_CLIENT, name))
    route = F.col("fact") == "route"
    verb = F.when(name == "RequestMapping", F.when(F.col("target").isNull(), "GET").otherwise(S.request_method(F.col("target")))).otherwise(_map(JAVA_ROUTES, name))
    stub = S._service(last, r"^(.+)Grpc\z")
    base = (F.col("fact") == "heritage") & (F.col("heritage_rel") == "inherits")
    record = F.try_element_at(F.when((_arg(0)["kind"] == "new") & (_arg(0)["text"] == "ProducerRecord"), _arg(0)["items"]), F.lit(1))
    return [
        _endpoint(route, verb, S.joined_route(F.coalesce("base", F.lit("")), F.coalesce("value", F.lit("")))),
        _client(call, method, _arg(0)),
        _one(base, "grpc_service", S._service(F.col("target"), r"^(.+)ImplBase\z")),
        _one(call & name.isin("newBlockingStub", "newStub", "newFutureStub"), "grpc_client", stub),
        _topic(call & (name == "send"), "topic_producer", record),
        _topics((form == "annotation") & (name == "KafkaListener"), "topic_consumer", F.col("methods")),
        _config(call & (last == "System") & (name == "getenv"), _lit(0)),
    ]


def csharp_rules() -> list[Column]:
    name, form, _, last, value = _cols()
    call = form == "call"
    route = F.col("fact") == "route"
    return [
        _endpoint(route, name, S.aspnet_route(F.coalesce("base", F.lit("")), F.coalesce("value", F.lit("")))),
        _endpoint(call, _map(CSHARP_MAP, name), _lit(0)),
        _client(call & ~name.isin(*CSHARP_MAP), _map(CSHARP_CLIENT, name), _arg(0)),
        _one(F.col("fact") == "heritage", "grpc_service", S.agreed_suffix(value, "Base")),
        _one(form == "new", "grpc_client", S.agreed_suffix(value, "Client")),
        _topic(call & name.isin("ProduceAsync", "Produce"), "topic_producer", _lit(0)),
        _topic(call & (name == "Subscribe"), "topic_consumer", _lit(0)),
        _config(call & (last == "Environment") & (name == "GetEnvironmentVariable"), _lit(0)),
        _config((form == "subscript") & last.isin("Configuration", "_configuration"), name),
    ]


def file_rules() -> dict[str, Column]:
    """By kind of fact: candidates of facts that aren't syntax of one language."""
    name, _, _, _, value = _cols()
    source = lambda of: _meta(source=F.lit(of))
    schema_meta = F.map_filter(_meta(package=value, methods=F.array_join(F.coalesce("methods", F.array()), " ")), lambda _, v: v.isNotNull() & (v != ""))
    always = F.lit(True)
    return {
        "string": F.transform(S.sql_tables(value), lambda t: _made("data_entity", key=t)),
        "openapi": F.array(_made("http_endpoint", method=F.upper(name), path=value, metadata=source("openapi"))),
        "helm_chart": F.array(_one(always, "service", S.normalized_service(value), source("helm"))),
        "helm_value": F.array(_one(name.rlike(S.SERVICE_KEY), "service_ref", S.service_of(value), source("helm-values"))),
        "gomod_module": F.array(_one(always, "package_publish", value, source("gomod"))),
        "gomod_require": F.array(_one(always, "package_dep", S.required_module(value), source("gomod"))),
        "schema": F.array(_one(always, "schema", name, schema_meta)),
    }


LANGUAGE_RULES = {("go",): go_rules, ("python",): python_rules, ("typescript", "javascript"): ts_rules, ("java",): java_rules, ("csharp",): csharp_rules}
#: Rules that give several candidates, as an array, among each language's.
SEVERAL = {("python",): (0, 7), ("java",): (5,)}


def _candidates() -> Column:
    """All candidates of a fact, nulls among them."""
    found = None
    for fact, rule in file_rules().items():
        at = F.col("fact") == fact
        found = F.when(at, rule) if found is None else found.when(at, rule)
    for langs, rules_of in LANGUAGE_RULES.items():
        rules = rules_of()
        many = [rules[i] for i in SEVERAL.get(langs, ())]
        single = F.array(*[r for i, r in enumerate(rules) if i not in SEVERAL.get(langs, ())])
        several = [F.coalesce(r, F.array().cast(f"array<{CANDIDATE}>")) for r in many]
        found = found.when(F.col("lang").isin(*langs), F.concat(single, *several) if several else single)
    return found


def contracts(facts: DataFrame) -> DataFrame:
    """world, rel, seq, kind, key, metadata of all contracts; tests of code give none."""
    usable = facts.where(~((F.col("route") == "code") & F.col("is_test")) | (F.col("fact") == "schema"))
    place = ["world", "repo_ord", "rel", "seq"]
    raw = usable.select(*place, F.explode(_candidates()).alias("c")).where("c is not null").select(*place, "c.*")
    url, kind = F.col("url"), F.col("kind")
    of_url = F.when(url["kind"] == "lit", S.url_path(url["lit"])).when(url["has_lit"], S.template_path(url["raw"]))
    pathed = raw.withColumn("path", F.when(kind == "http_client", of_url).otherwise(F.col("path")))
    path, method, key = F.col("path"), F.col("method"), F.col("key")
    http, topics = kind.isin("http_client", "http_endpoint"), kind.isin("topic_producer", "topic_consumer")
    good = method.isNotNull() & path.isNotNull() & (path != "") & ((kind == "http_client") | F.startswith(path, F.lit("/")))
    known = pathed.where(F.when(http, good).otherwise(key.isNotNull() & (key != "")))
    asked = _meta(method=method, path=path)
    metadata = (
        F.when(kind == "http_client", F.map_concat(asked, _meta(url=url["text"])))
        .when(kind == "http_endpoint", F.map_concat(asked, F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))))
        .when(topics, _meta(topic=key)).when(kind == "config_key", _meta(env=key)).when(kind == "data_entity", _meta(table=key))
        .otherwise(F.col("metadata"))
    )
    normal = F.when(http, S.http_key(method, path)).when(topics, S.topic_key(key)).otherwise(key)
    return known.select(*place, "kind", normal.alias("key"), metadata.alias("metadata"))
