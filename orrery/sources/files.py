"""From source trees to the code graph: scan, parse, nodes, edges."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import model
from orrery.functions import scalars as S
from orrery.operators.contracts import contracts
from orrery.operators.resolve import contains_edges, first_wins, unique_references
from orrery.sources.parsers import FACTS, FIELDS, facts
from orrery.tables import stored


@dataclass
class Graph:
    """The tables of one code graph."""

    nodes: DataFrame
    edges: DataFrame
    cross_edges: DataFrame
    worlds: DataFrame
    dirs: DataFrame
    world_meta: DataFrame | None = None


def listed(directory: str) -> list[tuple[str, str]]:
    """(relative path, absolute path) of all files, in lexical walk order; also names Spark's listing hides."""
    out = []
    root = os.path.abspath(directory)
    if os.path.basename(root) in model.SKIPPED_DIRS or (os.path.basename(root).startswith(".") and os.path.basename(root) != ".github"):
        return out

    def walk(at: str, rel: str) -> None:
        for name in sorted(os.listdir(at)):
            path, inner = os.path.join(at, name), f"{rel}{name}"
            if os.path.isdir(path) and not os.path.islink(path):
                if name not in model.SKIPPED_DIRS and not (name.startswith(".") and name != ".github"):
                    walk(path, inner + "/")
            elif os.path.isfile(path):
                out.append((inner, path))

    walk(root, "")
    return out


def world_name(path: str) -> str:
    clean = os.path.normpath(path)
    base = os.path.basename(clean)
    return os.path.basename(os.path.abspath(clean)) if base in ("", ".", "..", "/") else base


def provenance(directory: str) -> tuple[str, str]:
    """Origin URL and branch (or short commit) of a git checkout; empty where unknown."""

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", directory, *args], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return ""

    ref = git("rev-parse", "--abbrev-ref", "HEAD")
    return git("remote", "get-url", "origin"), git("rev-parse", "--short", "HEAD") if ref in ("", "HEAD") else ref


def repo_table(spark: SparkSession, repos: list[tuple[str, str]]) -> DataFrame:
    """world, repo_ord, directory: one row and one task per repository."""
    rows = [(world, k, os.path.abspath(directory)) for k, (world, directory) in enumerate(repos)]
    return spark.createDataFrame(rows, "world string, repo_ord int, directory string").repartitionByRange(max(1, len(rows)), "repo_ord")


def file_table(spark: SparkSession, repos: list[tuple[str, str]]) -> DataFrame:
    """world, repo_ord, rel, content of the files of (world, directory) pairs.

    Executors list and read them, a repository's directories in one task and its files
    in many; the driver holds repositories only. All must be on a path that they share.
    """

    def walked(batches):
        for pdf in batches:
            rows = [(r.world, r.repo_ord, rel, path) for r in pdf.itertuples() for rel, path in listed(r.directory)]
            yield type(pdf)(rows, columns=["world", "repo_ord", "rel", "path"])

    def read(batches):
        for pdf in batches:
            content = []
            for path in pdf.pop("path"):
                with open(path, "rb") as f:
                    content.append(f.read().decode("utf-8", "replace"))
            yield pdf.assign(content=content)

    paths = stored(repo_table(spark, repos).mapInPandas(walked, model.FILES).where(~S.is_generated(F.col("rel"))), "paths")
    tasks = max(1, min(paths.count() // 200 + 1, 10_000))
    return paths.repartition(tasks, "rel", "world").mapInPandas(read, "world string, repo_ord int, rel string, content string")


@lru_cache(maxsize=1)
def yaml_loader():
    """A safe loader that takes unknown tags for their values, keeps impossible dates as text and refuses repeated keys."""
    import yaml

    class Plain(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        def construct_mapping(self, node, deep=False):
            names = [self.construct_object(k, deep=True) for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
            if len(set(map(repr, names))) < len(names):
                raise yaml.YAMLError("a key occurs twice")
            return super().construct_mapping(node, deep)

    def untagged(loader, _, node):
        if isinstance(node, yaml.MappingNode):
            return loader.construct_mapping(node, deep=True)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node)

    def date(loader, node):
        try:
            return loader.construct_yaml_timestamp(node)
        except ValueError:
            return loader.construct_scalar(node)

    Plain.add_multi_constructor("!", untagged)
    Plain.add_multi_constructor("tag:", untagged)
    Plain.add_constructor("tag:yaml.org,2002:timestamp", date)
    return Plain


def first_document(content: str) -> object:
    """The first YAML document; raises ValueError for malformed text."""
    import yaml

    loader = None
    try:
        loader = yaml_loader()(content)
        return loader.get_data() if loader.check_data() else None
    except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
        raise ValueError(f"malformed YAML: {e}") from e
    finally:
        if loader is not None:
            loader.dispose()


def structured(route: str, rel: str, content: str) -> list[dict]:
    """Facts of OpenAPI specs, Helm files and go.mod; malformed YAML gives none."""
    blank = dict.fromkeys(FIELDS)
    out: list[dict] = []
    if route == "gomod":
        out.append(blank | {"fact": "file"})
        inside = False
        for line in map(str.strip, content.split("\n")):
            if not line or line.startswith("//"):
                continue
            if line.startswith("module "):
                out.append(blank | {"fact": "gomod_module", "value": line[7:].strip()})
            elif line == "require (":
                inside = True
            elif inside and line == ")":
                inside = False
            elif inside or line.startswith("require "):
                out.append(blank | {"fact": "gomod_require", "value": line if inside else line[8:]})
        return out
    try:
        doc = first_document(content)
    except ValueError:
        return []
    if route == "openapi":
        if not isinstance(doc, dict):
            return [blank | {"fact": "file"}] if doc is None else []
        paths = doc.get("paths") if isinstance(doc.get("paths"), dict) else {}
        pairs = sorted((str(p), str(v).upper()) for p, item in paths.items() if str(p).startswith("/") and isinstance(item, dict) for v in item if str(v).lower() in model.HTTP_VERBS)
        return [blank | {"fact": "file"}, *(blank | {"fact": "openapi", "name": v, "value": p} for p, v in pairs)]
    if route == "helm_chart":
        name = doc.get("name") if isinstance(doc, dict) else None
        parent = rel.rsplit("/", 2)[-2] if "/" in rel else "."
        return [blank | {"fact": "helm_chart", "value": str(name) if name else parent}]

    def walk(node) -> None:
        if isinstance(node, dict):
            for k, child in node.items():
                if isinstance(child, str):
                    out.append(blank | {"fact": "helm_value", "name": str(k), "value": child})
                walk(child)
        elif isinstance(node, list):
            for child in node:
                walk(child)

    walk(doc if isinstance(doc, dict) else {})
    return out


def fact_table(files: DataFrame) -> DataFrame:
    """Syntax facts of all files: world, repo_ord, rel, route, lang, is_test, seq and the fact's fields."""
    routed = files.where(~S.is_generated(F.col("rel")) & ~S.is_pruned_dir(F.col("rel"))).withColumn("route", S.route(F.col("rel"), F.col("content"))).where("route != 'skip'")
    routed = routed.select("world", "repo_ord", "rel", "route", S.language(F.col("rel")).alias("lang"), S.is_test_file(F.col("rel")).alias("is_test"), "content")
    head = "world string, repo_ord int, rel string, route string, lang string, is_test boolean, seq int, "

    def parse(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                lang = r.lang if isinstance(r.lang, str) else ""
                got = [dict.fromkeys(FIELDS) | {"fact": "file"}, *facts(r.content, lang)] if r.route == "code" else structured(r.route, r.rel, r.content)
                rows += [{"world": r.world, "repo_ord": r.repo_ord, "rel_path": r.rel, "route": r.route, "lang": lang, "is_test": bool(r.is_test), "seq": k, **f} for k, f in enumerate(got)]
            frame = type(pdf)(rows, columns=["world", "repo_ord", "rel_path", "route", "lang", "is_test", "seq", *FIELDS])
            yield frame.rename(columns={"rel": "heritage_rel", "rel_path": "rel"})

    return routed.mapInPandas(parse, head + FACTS.replace(" rel string", " heritage_rel string"))


def graph_nodes(facts_of: DataFrame) -> DataFrame:
    """Nodes by first occurrence of their id; contracts carry the key in it."""
    file_id = F.concat_ws("::", "world", "rel")
    imports = facts_of.where("fact = 'import'").groupBy("world", "rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), " ").alias("imports"))
    keyed = contracts(facts_of)
    none = F.lit(None).cast("map<string,string>")
    named = facts_of.where("fact = 'file'").select("world", "repo_ord", "rel")
    helm = keyed.where("kind in ('service', 'service_ref')").select("world", "repo_ord", "rel")
    every = named.union(helm).distinct().join(imports, ["world", "rel"], "left")
    of_files = every.select(
        file_id.alias("id"), "world", F.lit("file").alias("kind"), F.col("rel").alias("name"),
        F.when(F.col("imports").isNotNull(), F.create_map(F.lit("imports"), F.col("imports"))).alias("metadata"),
        F.col("rel").alias("rel_path"), F.lit(-1).alias("seq"), "repo_ord",
    )
    receiver = F.when(F.col("receiver").isNotNull(), F.create_map(F.lit("receiver"), F.col("receiver"))).otherwise(none)
    decls = facts_of.where("fact = 'decl'").select(F.concat_ws("::", file_id, "name").alias("id"), "world", "kind", "name", receiver.alias("metadata"), F.col("rel").alias("rel_path"), "seq", "repo_ord")
    found = keyed.select(F.concat_ws("::", file_id, "kind", "key").alias("id"), "world", "kind", F.col("key").alias("name"), "metadata", F.col("rel").alias("rel_path"), "seq", "repo_ord")
    return first_wins(of_files.union(decls).union(found), ["id"], ["repo_ord", "seq"])


def references(facts_of: DataFrame) -> DataFrame:
    """world, src, target, rel of calls within declarations and of heritage."""
    calls = facts_of.where("fact = 'call' and form = 'call' and decl is not null").select("world", F.concat_ws("::", "world", "rel", "decl").alias("src"), F.col("name").alias("target"), F.lit("calls").alias("rel"))
    # Python sees decorators of nested functions as calls too
    nested = facts_of.where("fact = 'heritage' and heritage_rel is not null").select("world", F.concat_ws("::", "world", "rel", "decl").alias("src"), "target", F.col("heritage_rel").alias("rel"))
    return calls.union(nested).where("target != ''")


def build(spark: SparkSession, repos: list[tuple[str, str]]) -> Graph:
    """The graph of (world, directory) pairs, without cross edges. Facts and nodes become tables, where plans start anew."""
    for _, directory in repos:
        os.listdir(directory)  # raises where there is none
    facts_of = stored(fact_table(file_table(spark, repos)), "facts")
    nodes = stored(graph_nodes(facts_of), "nodes")
    symbols = nodes.where(F.col("kind").isin("function", "method", "class", "interface")).select("id", "world", "kind", F.when(F.col("kind") == "method", F.substring_index("name", ".", -1)).otherwise(F.col("name")).alias("lookup"))
    edges = contains_edges(nodes).union(unique_references(symbols, references(facts_of)))
    meta = [(w, *provenance(path)) for w, path in repos]
    return Graph(
        nodes, edges, spark.createDataFrame([], model.CROSS_EDGES), spark.createDataFrame([(w,) for w, _ in repos], "world string"), directory_table(spark, repos),
        spark.createDataFrame([m for m in meta if m[1] or m[2]], "world string, repo_origin string, ref string"),
    )


def directory_table(spark: SparkSession, repos: list[tuple[str, str]]) -> DataFrame:
    """(world, dir): where service roots may lie, listed on the executors."""

    def walked(batches):
        for pdf in batches:
            yield type(pdf)([(r.world, d) for r in pdf.itertuples() for d in directories_of(r.directory)], columns=["world", "dir"])

    return repo_table(spark, repos).mapInPandas(walked, "world string, dir string")


def directories_of(path: str) -> list[str]:
    """Directories two levels deep, empty ones included."""
    out = []
    for name in sorted(os.listdir(path)):
        at = os.path.join(path, name)
        if os.path.isdir(at):
            out += [name, *(f"{name}/{x}" for x in sorted(os.listdir(at)) if os.path.isdir(os.path.join(at, x)))]
    return out
