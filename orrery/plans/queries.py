"""Queries over the driver tables, one or more per operator, each with its SQL.

The tables hold no source code, so operators run on relations derived from them:
hosts are worlds, URLs give keys, orders are keys that nations share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import model
from orrery.functions import scalars as S
from orrery.operators import gravity, resolve, split
from orrery.operators.contracts import contracts
from orrery.plans.corpora import CORPUS_QUERIES
from orrery.sources.files import fact_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# SQL texts of the normalizers, for an engine with RE2 patterns.
SQL_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
SQL_PATH = "CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END"


def sql_key(method: str, path: str) -> str:
    p = f"CASE WHEN regexp_replace({path}, '\\?.*$', '') = '' THEN '/' ELSE regexp_replace({path}, '\\?.*$', '') END"
    p = f"regexp_replace({p}, '\\{{[^/}}]+\\}}|\\$\\{{[^/}}]+\\}}|:[A-Za-z_][A-Za-z0-9_]*', '{{}}', 'g')"
    p = f"regexp_replace({p}, '/[0-9]+', '/{{}}', 'g')"
    p = f"regexp_replace({p}, '^/(api|v[0-9]+)(/|$)', '/')"
    return f"upper({method}) || ' ' || regexp_replace({p}, '//+', '/', 'g')"


SQL_SERVICE = f"""regexp_replace(lower(regexp_replace({SQL_HOST}, '[/:.].*$', '')), '-headless$', '')"""


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]*)", 1)


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as endpoints, those with a query string as clients, of their hosts."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.concat(host(url), F.lit("::"), F.col("page_id").cast("string")).alias("id"),
        host(url).alias("world"),
        F.when(url.contains("?"), "http_client").otherwise("http_endpoint").alias("kind"),
        S.http_key(F.lit("GET"), S.url_path(url)).alias("name"),
    )


@query(f"SELECT page_id, {sql_key("'GET'", SQL_PATH)} AS key FROM pages")
def q01_normalize_http_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.http_key(F.lit("get"), S.url_path(F.col("url"))).alias("key"))


@query(f"""WITH n AS (SELECT {SQL_HOST} AS world, {SQL_HOST} || '::' || page_id AS id, {sql_key("'GET'", SQL_PATH)} AS name, contains(url, '?') AS client FROM pages)
SELECT c.id AS src, p.id AS dst, 'http_call' AS rel, 'http' AS protocol, p.name AS contract_key, CAST(0.85 AS DOUBLE) AS confidence
FROM n p JOIN n c ON p.name = c.name AND p.world <> c.world AND NOT p.client AND c.client
WHERE substr(p.name, 5) NOT IN ({quoted(model.HTTP_NOISE)})""")
def q02_http_cross_edges(spark, sf_dir):
    return resolve.directional(page_nodes(spark, sf_dir))


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({SQL_PATH}, '[0-9]+', '{{}}', 'g'), '(\\{{\\}})+', '{{}}', 'g'), '//+', '/', 'g'), '([^/])\\{{\\}}$', '\\1') AS p FROM pages)
SELECT page_id, CASE WHEN regexp_replace(p, '/|\\{{\\}}', '', 'g') <> '' THEN p END AS path FROM p""")
def q03_template_path(spark, sf_dir):
    raw = F.concat(F.lit(S.SENTINEL), F.regexp_replace(S.url_path(F.col("url")), "[0-9]+", S.SENTINEL))
    return table(spark, sf_dir, "pages").select("page_id", S.template_path(raw).alias("path"))


@query(f"SELECT page_id, {SQL_SERVICE} AS service, {SQL_SERVICE} IN ({quoted(model.INFRA_NAMES + model.GENERIC_NAMES)}) AS noisy FROM pages")
def q04_service_from_value(spark, sf_dir):
    service = S.service_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", service.alias("service"), S.service_noise(service).alias("noisy"))


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 100), c AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 100)
SELECT lower(p.event_type) AS contract_key, count(*) AS n_edges, count(DISTINCT p.user_id) AS n_sources FROM p JOIN c ON lower(p.event_type) = lower(c.event_type) AND p.user_id <> c.user_id GROUP BY 1""")
def q05_pubsub_edges(spark, sf_dir):
    kind = F.when(F.col("value") >= 100, "topic_producer").when(F.col("value") < 100, "topic_consumer")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("world"), kind.alias("kind"), S.topic_key(F.col("event_type")).alias("name")).where("kind is not null").distinct()
    edges = resolve.directional(rows.withColumn("id", F.concat_ws("::", "world", "kind", "name")))
    return edges.groupBy("contract_key").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS n, p_brand AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT DISTINCT c_nationkey AS n, p_brand AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)
SELECT c.n || '::dep::' || c.b AS src, p.n || '::pub::' || p.b AS dst, 'depends_on' AS rel, p.b AS contract_key FROM p JOIN c ON p.b = c.b AND p.n <> c.n""")
def q06_package_edges(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    made = line.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n")), "l_suppkey").select("n", "p_brand", F.lit("pub").alias("as"), F.lit("package_publish").alias("kind"))
    bought = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n")), "c_custkey")
    used = line.join(bought, "l_orderkey").select("n", "p_brand", F.lit("dep").alias("as"), F.lit("package_dep").alias("kind"))
    nodes = made.union(used).distinct().select(F.concat_ws("::", "n", "as", "p_brand").alias("id"), F.col("n").cast("string").alias("world"), "kind", F.col("p_brand").alias("name"))
    return resolve.directional(nodes).select("src", "dst", "rel", "contract_key")


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("world"))
    name = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"))
    return line.join(nation, "l_suppkey").select(F.concat_ws("::", "world", name, F.col("l_linenumber").cast("string")).alias("id"), "world", F.lit("data_entity").alias("kind"), name.alias("name"))


@query("""WITH r AS (SELECT 'order_' || l_orderkey AS name, 'n' || s_nationkey AS world, min('n' || s_nationkey || '::order_' || l_orderkey || '::' || l_linenumber) AS id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), k AS (SELECT name FROM r GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)
SELECT a.id AS src, b.id AS dst, 'shares_table' AS rel, 'db' AS protocol, a.name AS contract_key, CAST(0.75 AS DOUBLE) AS confidence FROM r a JOIN r b ON a.name = b.name AND a.world < b.world JOIN k ON a.name = k.name""")
def q07_symmetric_pairs(spark, sf_dir):
    return resolve.symmetric(order_nodes(spark, sf_dir))


@query(f"""WITH t AS (SELECT DISTINCT upper(event_type) AS token FROM events UNION SELECT DISTINCT replace(p_type, ' ', '_') FROM part UNION SELECT 'OTEL_' || r_name FROM region UNION SELECT unnest(['PORT', 'debug', 'DATABASE_URL', 'otel_x', 'REDIS_ADDR']))
SELECT token, starts_with(upper(token), 'OTEL_') OR upper(token) IN ({quoted(model.CONFIG_NOISE)}) AS noisy FROM t""")
def q08_config_noise(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    given = spark.createDataFrame([(x,) for x in ("PORT", "debug", "DATABASE_URL", "otel_x", "REDIS_ADDR")], "token string")
    tokens = t("events").select(F.upper("event_type").alias("token")).union(t("part").select(F.replace("p_type", F.lit(" "), F.lit("_")))).union(t("region").select(F.concat(F.lit("OTEL_"), "r_name"))).union(given).distinct()
    return tokens.select("token", S.config_noise(F.col("token")).alias("noisy"))


@query("""WITH s AS (SELECT p_brand AS world, p_name AS lookup, p_brand || '::' || p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'interface' END AS kind FROM part),
u AS (SELECT world, lookup, CASE WHEN kind IN ('function', 'method') THEN 'calls' WHEN kind = 'class' THEN 'inherits' ELSE 'implements' END AS rel, min(id) AS dst FROM s GROUP BY 1, 2, 3 HAVING count(*) = 1),
r AS (SELECT DISTINCT p_brand AS world, 's' || l_suppkey AS src, p_name AS target, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'inherits' ELSE 'implements' END AS rel FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT DISTINCT r.src, u.dst, r.rel FROM r JOIN u ON r.world = u.world AND r.target = u.lookup AND r.rel = u.rel""")
def q09_unique_references(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size") % 4
    kind = F.when(size == 0, "function").when(size == 1, "method").when(size == 2, "class").otherwise("interface")
    symbols = part.select(F.concat_ws("::", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("world"), kind.alias("kind"), F.col("p_name").alias("lookup"))
    flag = F.col("l_returnflag")
    rel = F.when(flag == "A", "calls").when(flag == "R", "inherits").otherwise("implements")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), rel.alias("rel"))
    refs = line.join(part.select("p_partkey", F.col("p_brand").alias("world"), F.col("p_name").alias("target")), "p_partkey").select("world", "src", "target", "rel").distinct()
    return resolve.unique_references(symbols, refs)


@query("""SELECT role, turn, conv_id, n FROM (SELECT role, turn, conv_id, length(text) AS n, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS k FROM conversations) WHERE k = 1""")
def q10_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", "turn", "conv_id", F.length("text").cast("bigint").alias("n"))
    return resolve.first_wins(rows, ["role", "turn"], ["conv_id"])


@query(f"""WITH n AS (SELECT {SQL_HOST} AS host, regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS seg, page_id FROM pages),
k AS (SELECT *, CASE WHEN seg <> '' THEN 'cmd/' || seg || '/p' ELSE 'internal/p' END || page_id AS rel FROM n),
g AS (SELECT *, seg <> '' AND (NOT (host LIKE '%.com') OR seg IN ('en', 'de')) AS moves FROM k)
SELECT CASE WHEN moves THEN seg ELSE host END || '::' || rel AS id, CASE WHEN moves THEN seg ELSE host END AS world FROM g""")
def q11_split_worlds(spark, sf_dir):
    seg = F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1)
    rel = F.concat(F.when(seg != "", F.concat(F.lit("cmd/"), seg, F.lit("/p"))).otherwise("internal/p"), F.col("page_id").cast("string"))
    files = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("world"), rel.alias("rel"))
    gates = files.where(F.col("world").endswith(".com")).select("world").distinct().select("world", F.explode(F.array(F.lit("charts/en"), F.lit("charts/de"))).alias("dir"))
    dirs = split.directories(files).union(gates)
    nodes = files.select(F.concat_ws("::", "world", "rel").alias("id"), "world", F.lit("file").alias("kind"), F.col("rel").alias("name"))
    none = spark.createDataFrame([], model.EDGES)
    options = split.Options(roots=("cmd/*",))
    return split.split_worlds(nodes, none, none, dirs, options)[0].select("id", "world")


SQL_LINKS = """links AS (SELECT CAST(c_nationkey AS VARCHAR) AS x, CAST(s_nationkey AS VARCHAR) AS y,
CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1.5 WHEN '4-NOT SPECIFIED' THEN 0.5 ELSE 1 END AS DOUBLE) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
adj AS (SELECT least(x, y) AS a, greatest(x, y) AS b, sum(weight) AS weight FROM links WHERE x <> y GROUP BY 1, 2),
deg AS (SELECT w, sum(weight) AS d FROM (SELECT a AS w, weight FROM adj UNION ALL SELECT b, weight FROM adj) GROUP BY 1)"""


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross edge per order line between its customer's and its supplier's nation."""
    t = lambda name: table(spark, sf_dir, name)
    known = {"1-URGENT": "db", "2-HIGH": "k8s", "3-MEDIUM": "config", "4-NOT SPECIFIED": "pubsub"}
    protocol = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), "o_orderpriority"), F.lit("http"))
    buyer = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), protocol.alias("protocol")).join(t("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("a")), "c_custkey")
    line = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    return line.join(t("supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("b")), "s_suppkey").join(buyer, "o_orderkey").select("a", "b", S.weight(F.col("protocol")).alias("weight"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("world"))


@query(f"WITH {SQL_LINKS} SELECT a, b, weight FROM adj")
def q12_adjacency(spark, sf_dir):
    return gravity.adjacency(nation_links(spark, sf_dir))


@query(f"WITH {SQL_LINKS} SELECT CAST(n_nationkey AS VARCHAR) AS world, coalesce(d, 0) AS mass FROM nation LEFT JOIN deg ON w = CAST(n_nationkey AS VARCHAR)")
def q13_mass(spark, sf_dir):
    return gravity.mass(nations(spark, sf_dir), gravity.adjacency(nation_links(spark, sf_dir)))


@query(f"WITH {SQL_LINKS}, n AS (SELECT count(*) AS n FROM nation), p AS (SELECT count(*) AS p FROM adj) SELECT n AS n_worlds, p AS pair_edges, trunc(p / (n * (n - 1) / 2.0) * 10000 + 0.5) / 10000.0 AS density FROM n, p")
def q14_density(spark, sf_dir):
    out = gravity.density(nations(spark, sf_dir), gravity.adjacency(nation_links(spark, sf_dir)))
    return out.select("n_worlds", "pair_edges", S.round4(F.col("density")).alias("density"))


@query(f"""WITH {SQL_LINKS}, m AS (SELECT sum(weight) AS m FROM adj), r AS (SELECT CAST(n_nationkey AS VARCHAR) AS w, n_regionkey AS c FROM nation),
l AS (SELECT ra.c AS c, sum(weight) AS l FROM adj JOIN r ra ON a = ra.w JOIN r rb ON b = rb.w AND ra.c = rb.c GROUP BY 1), d AS (SELECT c, sum(d) AS d FROM deg JOIN r USING (w) GROUP BY 1)
SELECT trunc(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))) * 10000 + 0.5) / 10000.0 AS modularity FROM d LEFT JOIN l USING (c), m""")
def q15_modularity(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("world"), F.col("n_regionkey").cast("string").alias("community"))
    return gravity.modularity(gravity.adjacency(nation_links(spark, sf_dir)), regions).select(S.round4(F.col("modularity")).alias("modularity"))


def host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that share an exact path, weighted by the number of shared paths."""
    p = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("w"), F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
    return p.alias("p").join(p.alias("q"), (F.col("p.path") == F.col("q.path")) & (F.col("p.w") < F.col("q.w"))).select(F.col("p.w").alias("a"), F.col("q.w").alias("b"), F.lit(1.0).alias("weight"))


def sql_moves(adjacent: str, worlds: str) -> str:
    """CTEs for local moving over the CTEs ``adjacent`` (a, b, weight) and ``worlds`` (w): one recursion step per visit.

    ``label`` holds places of worlds in sorted order. A sweep that moves none ends it.
    """
    held = "list_sum(list_transform(range(1, n + 1), lambda j: CASE WHEN j <> i AND label[j] = c THEN deg[j] ELSE 0 END))"
    pull = "list_sum(list_transform(range(1, n + 1), lambda j: CASE WHEN label[j] = c THEN m[i][j] ELSE 0 END))"
    near = "list_filter(list_distinct(list_transform(list_filter(range(1, n + 1), lambda j: j = i OR m[i][j] > 0), lambda j: label[j])), lambda c: true)"
    scored = f"list_transform({near}, lambda c: {{'g': -({pull} - {held} * deg[i] / total), 'c': c}})"
    chosen = f"list_sort(list_append({scored}, {{'g': CAST(0 AS DOUBLE), 'c': i}}))[1]['c']"
    return f"""ranked AS (SELECT w, row_number() OVER (ORDER BY w) AS k FROM {worlds}),
cells AS (SELECT x.k AS r, y.k AS c, coalesce(sum(weight), 0) AS v FROM ranked x CROSS JOIN ranked y LEFT JOIN {adjacent} ON (a = x.w AND b = y.w) OR (a = y.w AND b = x.w) GROUP BY 1, 2),
lines AS (SELECT r, list(v ORDER BY c) AS line, sum(v) AS d FROM cells GROUP BY 1),
graph AS (SELECT list(line ORDER BY r) AS m, list(d ORDER BY r) AS deg, sum(d) AS total, count(*) AS n FROM lines),
moves AS (SELECT CAST(0 AS BIGINT) AS visit, CAST(1 AS BIGINT) AS i, (SELECT range(1, n + 1) FROM graph) AS label, false AS moved, false AS done
UNION ALL SELECT visit + 1, CASE WHEN i = n THEN 1 ELSE i + 1 END, after, CASE WHEN i = n THEN false ELSE moved OR after <> label END, i = n AND NOT (moved OR after <> label)
FROM (SELECT *, list_concat(list_concat(label[1:i - 1], [best]), label[i + 1:n]) AS after FROM (SELECT *, {chosen} AS best FROM moves, graph WHERE NOT done AND visit < 100 * n AND total > 0))),
found AS (SELECT x.w AS world, y.w AS community FROM (SELECT unnest(label) AS l, unnest(range(1, n + 1)) AS k FROM (SELECT label FROM moves ORDER BY visit DESC LIMIT 1), graph) JOIN ranked x USING (k) JOIN ranked y ON y.k = l)"""


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT {SQL_HOST} AS w, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
adj AS (SELECT p.w AS a, q.w AS b, CAST(count(*) AS DOUBLE) AS weight FROM p JOIN p q ON p.path = q.path AND p.w < q.w GROUP BY 1, 2), ws AS (SELECT a AS w FROM adj UNION SELECT b FROM adj),
{sql_moves("adj", "ws")} SELECT world, community FROM found""")
def q16_communities(spark, sf_dir):
    adjacent = gravity.adjacency(host_links(spark, sf_dir))
    return gravity.communities(adjacent.select(F.explode(F.array("a", "b")).alias("world")).distinct(), adjacent)


@query(f"""WITH RECURSIVE {SQL_LINKS}, ws AS (SELECT CAST(n_nationkey AS VARCHAR) AS w FROM nation), {sql_moves("adj", "ws")},
m AS (SELECT sum(weight) AS m FROM adj), l AS (SELECT x.community AS c, sum(weight) AS l FROM adj JOIN found x ON a = x.world JOIN found y ON b = y.world AND x.community = y.community GROUP BY 1),
d AS (SELECT community AS c, sum(d) AS d FROM deg JOIN found ON w = world GROUP BY 1), q AS (SELECT sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))) AS q FROM d LEFT JOIN l USING (c), m),
g AS (SELECT string_agg(world, ' ' ORDER BY world) AS g, count(*) AS size, min(world) AS first FROM found GROUP BY community), e AS (SELECT count(*) AS p FROM adj), n AS (SELECT count(*) AS n FROM ws)
SELECT (SELECT string_agg(ws.w || ':' || CAST(floor(coalesce(d, 0)) AS BIGINT), ',' ORDER BY coalesce(d, 0) DESC, ws.w) FROM ws LEFT JOIN deg ON deg.w = ws.w) AS masses, (SELECT string_agg(g, '|' ORDER BY size DESC, first) FROM g) AS galaxies,
trunc(q * 10000 + 0.5) / 10000.0 AS modularity, CAST(p AS INT) AS pair_edges, trunc(p / (n * (n - 1) / 2.0) * 10000 + 0.5) / 10000.0 AS density, n >= 4 AND p / (n * (n - 1) / 2.0) >= 0.5 AND q < 0.2 AS black_hole FROM q, e, n""")
def q17_gravity_report(spark, sf_dir):
    report = gravity.report_of(nations(spark, sf_dir), gravity.adjacency(nation_links(spark, sf_dir)))
    masses = F.array_join(F.transform("worlds", lambda w: F.concat(w["world"], F.lit(":"), F.floor(w["mass"]).cast("string"))), ",")
    groups = F.array_join(F.transform("galaxies", lambda g: F.array_join(g, " ")), "|")
    return report.select(masses.alias("masses"), groups.alias("galaxies"), "modularity", "pair_edges", "density", "black_hole")


@query(f"""WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'SELECT a FROM ' || replace(p_brand, '#', '_') || ' JOIN pg_x WHERE 1' WHEN 1 THEN 'insert into ' || lower(split_part(p_type, ' ', 1)) || '.items VALUES'
WHEN 2 THEN 'CREATE TABLE IF NOT EXISTS ' || split_part(p_type, ' ', 2) ELSE p_name || ' from where' END AS s FROM part),
e AS (SELECT p_partkey, unnest(regexp_extract_all(s, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\\s+["''`]?([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS x FROM t WHERE strlen(s) >= 12 AND regexp_matches(s, '(?i)\\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|REPLACE|MERGE)\\b'))
SELECT DISTINCT p_partkey, lower(x) AS name, (strlen(x) <= 2 OR regexp_matches(lower(x), '^(pg_|sqlite_)') OR split_part(lower(x), '.', 1) IN ({quoted(model.TABLE_NOISE)})) AS noisy FROM e""")
def q18_sql_tables(spark, sf_dir):
    size, words = F.col("p_size") % 4, F.split("p_type", " ")
    s = (
        F.when(size == 0, F.concat(F.lit("SELECT a FROM "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" JOIN pg_x WHERE 1")))
        .when(size == 1, F.concat(F.lit("insert into "), F.lower(words[0]), F.lit(".items VALUES")))
        .when(size == 2, F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))))
        .otherwise(F.concat("p_name", F.lit(" from where")))
    )
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(S.sql_tables(s)).alias("name"))
    return found.select("p_partkey", "name", S.table_noise(F.col("name")).alias("noisy"))


GRPC_SHAPES = ["New{}Client", "NewMock{}Client", "Register{}Server", "RegisterHealthServer", "{}Stub", "add_{}Servicer_to_server", "NewRedisClient"]
SQL_GRPC_NAME = "CASE " + " ".join(f"WHEN p_partkey % 7 = {i} THEN " + " || ".join(f"'{x}'" if x else "''" for x in s.replace("{}", "\0b\0").split("\0")).replace("'b'", "replace(p_brand, '#', '')") for i, s in enumerate(GRPC_SHAPES)) + " END"


@query(f"""WITH n AS (SELECT p_partkey, {SQL_GRPC_NAME} AS name FROM part), x AS (SELECT p_partkey, name, regexp_extract(name, '^New(.+)Client$', 1) AS c, regexp_extract(name, '^Register(.+)Server$', 1) AS s, regexp_extract(name, '^(.+)Stub$', 1) AS t, regexp_extract(name, '^add_(.+)Servicer_to_server$', 1) AS r FROM n)
SELECT p_partkey, name, CASE WHEN c NOT IN ({quoted(model.GRPC_NON_SERVICES)}) AND NOT regexp_matches(c, '^(Mock|Fake|Stub|Spy)') THEN c END AS client,
CASE WHEN s NOT IN ({quoted([*model.GRPC_NON_SERVICES, "Health", "ServerReflection"])}) AND NOT regexp_matches(s, '^(Mock|Fake|Stub|Spy)') THEN s END AS server,
CASE WHEN t NOT IN ({quoted(model.GRPC_NON_SERVICES)}) THEN t END AS stub, CASE WHEN r NOT IN ({quoted(model.GRPC_NON_SERVICES)}) THEN r END AS registrar FROM x""")
def q19_grpc_names(spark, sf_dir):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    shapes = F.array(*[F.concat(*[F.lit(x) if x != "b" else brand for x in s.replace("{}", "\0b\0").split("\0")]) for s in GRPC_SHAPES])
    name = F.col("name")
    named = table(spark, sf_dir, "part").select("p_partkey", F.element_at(shapes, (F.col("p_partkey") % 7 + 1).cast("int")).alias("name"))
    return named.select("p_partkey", "name", S.go_grpc_client(name).alias("client"), S.go_grpc_server(name).alias("server"), S.python_stub(name).alias("stub"), S.python_registrar(name).alias("registrar"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN '' ELSE 'example.com/' || replace(p_brand, '#', '') END AS module FROM part""")
def q20_required_module(spark, sf_dir):
    module = F.concat(F.lit("\texample.com/"), F.replace("p_brand", F.lit("#"), F.lit("")))
    size = F.col("p_size")
    entry = F.concat(module, F.when(size % 5 == 0, " latest").otherwise(" v1.2.0"), F.when(size % 3 == 0, " // indirect").otherwise(" // pinned"))
    return table(spark, sf_dir, "part").select("p_partkey", S.required_module(entry).alias("module"))


PATHS = ["a/b_test.go", "a/Contest.cs", "src/test/x.java", "pkg/testdata/y.go", "x/FooTests.cs", "test_a.py", "web/a.spec.tsx", "a/latest.py", "api/x.pb.go", "gen/y_pb2.py", "src/tests/z.ts", "conftest.py"]


@query(f"""WITH p AS (SELECT p_partkey, replace(p_brand, '#', '') || '/' || ([{quoted(PATHS)}])[CAST(p_partkey % {len(PATHS)} AS INT) + 1] AS rel FROM part)
SELECT p_partkey, regexp_matches('/' || rel, '/(testdata|__tests__|__mocks__)/|/src/tests?(/|$)|_test\\.(go|py)$|/test_[^/]*\\.py$|/conftest\\.py$|\\.(test|spec)\\.(ts|tsx|js|jsx)$|Tests?\\.(java|cs)$') AS is_test, regexp_matches(rel, '(\\.pb\\.go|_pb2\\.py)$') AS generated FROM p""")
def q21_is_test_file(spark, sf_dir):
    rel = F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS) + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", S.is_test_file(rel).alias("is_test"), S.is_generated(rel).alias("generated"))


@query(f"""WITH p AS (SELECT page_id, {SQL_PATH} AS path, regexp_extract(url, '^https?://[^/]*/([a-z]+)', 1) AS seg FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/' || seg || path ELSE '/' || seg || '/x' END AS spring, CASE WHEN page_id % 2 = 0 THEN path ELSE '/' || seg || '/x' END AS aspnet, CASE WHEN page_id % 3 = 0 THEN 'PUT' ELSE 'GET' END AS method FROM p""")
def q22_route_join(spark, sf_dir):
    base = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]*/([a-z]+)", 1))
    path = F.when(F.col("page_id") % 2 == 0, S.url_path(F.col("url"))).otherwise(F.lit("x"))
    method = F.when(F.col("page_id") % 3 == 0, "RequestMethod.PUT").otherwise("{RequestMethod.PUT}")
    return table(spark, sf_dir, "pages").select("page_id", S.joined_route(base, path).alias("spring"), S.aspnet_route(base, path).alias("aspnet"), S.request_method(method).alias("method"))


@query(f"SELECT 'p' || page_id AS world, {sql_key('v.m', SQL_PATH)} AS key FROM pages, (VALUES ('GET'), ('POST')) v(m)")
def q23_openapi_endpoints(spark, sf_dir):
    spec = F.to_json(F.struct(F.create_map(S.url_path(F.col("url")), F.struct(F.lit("").alias("get"), F.lit("").alias("post"), F.lit("").alias("x-note"))).alias("paths")))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("world"), F.lit(0).alias("repo_ord"), F.lit("api/openapi.json").alias("rel"), spec.alias("content"))
    return contracts(fact_table(files)).select("world", "key")


@query(f"""SELECT kind, world, count(*) AS n FROM (SELECT CASE WHEN contains(url, '?') THEN 'http_client' ELSE 'http_endpoint' END AS kind, {SQL_HOST} AS world FROM pages
UNION ALL SELECT 'data_entity', 'n' || s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2""")
def q24_merge_worlds(spark, sf_dir):
    return resolve.merge(page_nodes(spark, sf_dir), order_nodes(spark, sf_dir)).groupBy("kind", "world").agg(F.count("*").alias("n"))


@query("SELECT string_agg(n_name, ',' ORDER BY n_name) AS members, CAST(count(*) AS INT) AS size FROM nation GROUP BY n_regionkey")
def q25_galaxies(spark, sf_dir):
    found = table(spark, sf_dir, "nation").select(F.col("n_name").alias("world"), F.col("n_regionkey").alias("community"))
    return gravity.galaxies(found).select(F.array_join("members", ",").alias("members"), "size")


CODE = {
    "go": ("main.go", 'package main\nfunc run() {{ http.Get(host + "/{b}/" + id); os.Getenv("VAR_{b}"); db.Query("SELECT x FROM t_{b} WHERE y") }}\n', [("http_client", "GET /{b}/{{}}"), ("config_key", "VAR_{b}"), ("data_entity", "t_{l}")]),
    "python": ("app.py", '@app.route("/{b}/<id>", methods=["POST"])\ndef f():\n    producer.send("Topic.{b}", 1)\n', [("http_endpoint", "POST /{b}/<id>"), ("topic_producer", "topic.{l}")]),
    "typescript": ("a.ts", 'export function f() {{ fetch(`${{base}}/{b}/${{id}}`); consumer.subscribe({{ topic: "Topic.{b}" }}); return process.env.VAR_{b} }}\n', [("http_client", "GET /{b}/{{}}"), ("topic_consumer", "topic.{l}"), ("config_key", "VAR_{b}")]),
    "java": ("A.java", '@RequestMapping("/api")\nclass A {{ @PostMapping("/{b}/{{id}}") void f() {{ {b}Grpc.newStub(c); }} }}\n', [("http_endpoint", "POST /{b}/{{}}"), ("grpc_client", "{b}")]),
    "csharp": ("A.cs", 'class A : {b}.{b}Base {{ [HttpDelete("/{b}/{{id}}")] public int F() {{ return 1; }} }}\n', [("grpc_service", "{b}"), ("http_endpoint", "DELETE /{b}/{{}}")]),
    "proto": ("a.proto", "package x;\nservice {b} {{ rpc Get (A) returns (B); }}\n", [("schema", "{b}")]),
}
BRAND = "replace(p_brand, '#', '')"


def _sql_text(pattern: str) -> str:
    parts = pattern.replace("{{", "\1").replace("}}", "\2").replace("{b}", "\0b\0").replace("{l}", "\0l\0").split("\0")
    return " || ".join(BRAND if p == "b" else f"lower({BRAND})" if p == "l" else "'" + p.replace("\1", "{").replace("\2", "}") + "'" for p in parts)


@query(" UNION ALL ".join(f"SELECT 'w' || p_partkey AS world, '{rel}' AS rel, '{kind}' AS kind, {_sql_text(key)} AS key FROM part" for rel, _, found in CODE.values() for kind, key in found))
def q26_code_contracts(spark, sf_dir):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    sources = F.array(*[F.struct(F.lit(rel).alias("rel"), F.replace(F.lit(src.format(b="@@")), F.lit("@@"), brand).alias("content")) for rel, src, _ in CODE.values()])
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("world"), F.lit(0).alias("repo_ord"), F.explode(sources).alias("f")).select("world", "repo_ord", "f.*")
    return contracts(fact_table(files)).select("world", "rel", "kind", "key")


for _name, (_query, _sql) in CORPUS_QUERIES.items():
    QUERIES[_name], ORACLE_SQL[_name] = _query, _sql
