"""Small sources of an imaginary observatory, and what they must give.

Each query extracts, resolves or analyses these sources; its SQL is the table of
expected rows. Between them they hold at least two shapes of every rule.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.emit import graph_json, gravity_json
from orrery.functions import scalars as S
from orrery.operators import gravity, split
from orrery.operators.contracts import contracts
from orrery.operators.resolve import contains_edges, resolve, unique_references
from orrery.sources.files import Graph, fact_table, graph_nodes, references, world_name
from orrery.tables import new_path, stored

FILES = "world string, repo_ord int, rel string, content string"

GO = r'''package dome
import "os"
import (
    sky "example.org/sky"
    "net/http"
)
type Shutter interface { Open() }
type Motor struct { torque int }
type (
    Gear struct{}
    Axis = Gear
)
type Ring[T any] struct { items []T }
func Build() *Motor { return tune(&Motor{}) }
func tune(m *Motor) *Motor { go func() { settle() }(); return m }
func settle() {}
func (m *Motor) Spin() { m.brake() }
func (m *Motor) brake() {}
func (g Gear) Spin() {}
func (r *Ring[T]) Push(v T) {}
func wire() {
    mux.HandleFunc("/comets/{name}/tail", tail)
    mux.Handle("PUT /mirrors/9", mirrors)
    grid.DELETE("/exposures/:frame", drop)
    grid.Patch("/exposures", change)
    grid.GET("relative", skip)
    lamp.Get("colour")
    http.Head("https://vault.example/api/v2/plates?limit=3")
    http.PostForm(base+"/flats/"+night+"/master", form)
    http.NewRequest("DELETE", "http://ann:pw@vault.example:8080/plates/77", nil)
    http.NewRequestWithContext(ctx, "PUT", "https://vault.example/darks", body)
    http.Get("http://vault.example:80x/lost")
    http.Get(address)
    bus.Publish("Sky.Clear", note)
    bus.QueueSubscribe("wind.gust", "crew", onGust)
    bus.ConsumePartition("seeing", 0, 1)
    kafka.Writer{Topic: "focus.runs"}
    kafka.NewReader(kafka.ReaderConfig{Brokers: b, Topic: "Guide.Stars"})
    pb.RegisterTrackerServer(s, impl)
    pb.RegisterHealthServer(s, impl)
    pb.NewWeatherClient(conn)
    pb.NewFakeWeatherClient(t)
    pb.NewRedisClient(conn)
    os.Getenv("DOME_KEY")
    os.LookupEnv("MAST_URL")
    os.Setenv("IGNORED", "x")
    store.Query("select id from plates p join nights n on true")
    store.Exec(`UPDATE pointing SET ra = 1 WHERE id = 2`)
    store.Query("short from")
}
'''
GO_TEST = 'package dome\nfunc TestIt() { os.Getenv("ONLY_IN_TESTS"); http.Get("http://h/only/in/tests") }\n'

PYTHON = r'''import os, json as js
from pipeline.flat import field
from . import local
class Camera(Device):
    def expose(self):
        self.cool(); record()
    def cool(self): pass
class Device:
    pass
def record():
    """Choose one from the list of many"""
    requests.patch("http://vault.example/plates/12/label")
    session.delete(f"{vault}/plates/{number}")
    httpx.get("http://" + host + "/nights/" + night)
    client.post("no-path")
    other.get("/not/a/client")
    producer.publish("Frame.Ready", 1)
    reader = KafkaConsumer("calibration")
    sub.subscribe("wind.gust")
    sub.subscribe(["sky.clear", "Sky.Cloud"])
    os.environ["MAST_URL"] = "x"
    os.environ.get("CAMERA_GAIN")
    os.getenv("CAMERA_BIAS")
    stub = sky_grpc.WeatherStub(channel)
    sky_grpc.add_ShutterServicer_to_server(Impl(), server)
    run("INSERT INTO plates(id) VALUES (1)")
    run(f"DELETE FROM {table} WHERE 1")
@router.head("/plates/{plate}")
def plate(): pass
@flask.route("/nights/<night>")
def night(): pass
@flask.route("/nights", methods=["post", "PUT"])
async def nights():
    await plate()
@router.options(PREFIX)
def nothing(): pass
if DEBUG:
    def hidden(): pass
'''

TYPESCRIPT = r'''import dial from "./dial";
import * as axios from 'axios';
export interface Gauge { read(): number }
export default class Panel extends Board implements Gauge {
  read(): number { return this.scale(level()); }
  scale(n: number) { return n }
  poll = () => { level(); };
}
abstract class Board { mount(): void { paint() } }
function* paint() { yield level(); }
export async function level(): Promise<number> {
  app.all("/dials/:dial", h); board.api.options('/dials', h); this.http.put("/panels/4", x); app.get("dials", h);
  fetch("https://vault.example/plates/5", { method: "DELETE" }); axios(`${root}/nights/${id}/log`); axios.head("http://vault.example/");
  http.delete(root + "/plates/" + id); axios.options("/never");
  bus.publish("Dial.Turned", x); out.send({ topic: "focus.runs", messages }); out.send("plain");
  inn.subscribe("dial.turned"); inn.subscribe({ "topic": "Frame.Ready" });
  const a = process.env.PANEL_KEY, b = process.env["MAST_URL"], c = process.env[name];
  new sky.WeatherClient(url); new TrackerClient(url); new HttpClient(url);
  db.run("SELECT * FROM panels"); db.run(`SELECT * FROM ${table}`);
  return 1;
}
const arrow = () => level();
'''
JAVASCRIPT = "class Knob extends Dial {\n  turn() { this.click(); spin(); }\n  click() {}\n}\nfunction spin() { app.post('/knobs/:knob', h); }\nexport const never = () => spin();\n"

JAVA = r'''package obs;
import java.util.List;
import static org.sky.Units.*;
@RequestMapping(path = "/v3/nights")
public class NightLog extends TrackerGrpc.TrackerImplBase implements Journal {
  @PutMapping(value = "/{night}/notes") public String write(String night) { return stamp(); }
  @DeleteMapping("notes") void wipe() { }
  @RequestMapping(value = "/search", method = {RequestMethod.POST, RequestMethod.PUT}) void search() { }
  @RequestMapping(path = "/open", method = RequestMethod.PATCH) void open() { }
  private String stamp() {
    rest.postForLocation("http://vault.example/plates", p); rest.getForEntity(vault + "/plates/" + id, X.class);
    rest.delete("http://vault.example/darks/3"); rest.exchange("http://vault.example/flats", HttpMethod.OPTIONS, e, X.class); rest.exchange(u + "/flats/" + n, verb, e);
    WeatherGrpc.newBlockingStub(c); ShutterGrpc.newFutureStub(c); ShutterGrpc.getDescriptor();
    out.send(new ProducerRecord<String, String>("Night.Begun", v)); out.send("frame.ready");
    System.getenv("NIGHT_KEY"); System.getenv("MAST_URL"); other.getenv("NOT_THIS");
    jdbc.update("insert into nights values (1)"); return "";
  }
  @KafkaListener(topics = "night.begun") void one(String m) { }
  @KafkaListener(topics = {"sky.clear", "Sky.Cloud"}, groupId = "g") void two(String m) { }
  static class Entry { @GetMapping("/entries") List<String> list() { return null; } }
}
interface Journal { String write(String night); }
enum Phase { DUSK, DAWN; void skip() { } }
record Span(int a, int b) { int size() { return b - a; } }
class ShutterService extends ShutterImplBase { ShutterService() { } }
'''

CSHARP = r'''using System;
using Sky.Units;
namespace Obs.Plates {
  [Route("/plates")]
  public class PlateBox : Tracker.TrackerBase, IBox {
    [HttpPut("{plate}/label")] public async Task<int> Label(int plate) { await Dust(); return 1; }
    [HttpHead][Route("count")] public int Count() { return 0; }
    [HttpPatch("/shelves/{shelf}")] public void Shelf() { }
    void Dust() {
      http.DeleteAsync("http://vault.example/plates/8"); http.GetStringAsync(vault + "/nights/" + n); http.PutAsJsonAsync($"{vault}/darks/{d}", x); http.GetFromJsonAsync<Plate>("http://vault.example/lost");
      app.MapDelete("/boxes/{box}", f); app.MapPut("/boxes", f); app.MapGet(route, f);
      bus.Produce("Plate.Moved", m); bus.ProduceAsync("frame.ready", m); bus.Subscribe("Night.Begun"); bus.Subscribe(name);
      Environment.GetEnvironmentVariable("PLATE_KEY"); var a = _configuration["MAST_URL"]; var b = Configuration["Box:Size"]; var c = other["no"];
      new Weather.WeatherClient(ch); new Obs.Shutter.ShutterClient(ch); new Weather.OtherClient(ch);
      db.Run("DELETE FROM boxes WHERE id = 1"); db.Run($"DELETE FROM {t}"); db.Run(@"DROP TABLE verbatim");
    }
  }
  interface IBox { }
  struct Slot { public int Read() { return 0; } }
  record Tag(int Id);
  class Shutters : Obs.Shutter.ShutterBase { }
  class Loose : Weather.TrackerBase { }
}
'''

PROTO = 'syntax = "proto3";\npackage sky.v1;\nservice Weather {\n  rpc Now (Ask) returns (Sky);\n  rpc Watch (Ask) returns (stream Sky) {}\n}\nservice Tracker { rpc Point (Aim) returns (Ok); }\nmessage Ask { string at = 1; }\n'

OPENAPI = "openapi: 3.1.0\ninfo: {title: vault, version: 2024-02-30}\nservers: [{url: http://ignored/base}]\npaths:\n  /plates/{plate}:\n    GET: {}\n    put: {}\n    parameters: []\n  /api/v2/nights:\n    trace: {}\n  plates: {get: {}}\n  x-note: {get: {}}\n---\npaths: {/second/document: {get: {}}}\n"
SWAGGER = '{\n  "swagger": "2.0",\n  "paths": {"/darks/7": {"post": {}, "connect": {}}}\n}\n'
VALUES = "gauge:\n  VAULT_URL: https://vault.lab.svc:8443/x\n  CACHE_HOST: redis\n  NOTES: vault\nlist:\n  - Mast_Endpoint: mast-headless\n  - name: LOST_HOST\n    value: lost\nPIER_ADDR: 10\nZERO_SVC: 0.0.0.0\nOTHER_UPSTREAM: !ref panel:80\n"
GOMOD = "module example.org/dome\n\ngo 1.23\n\nrequire example.org/sky v0.4.1 // pinned\nrequire (\n\texample.org/units v1.0.0\n\texample.org/hidden v1.2.0 // indirect\n\t// example.org/off v1.0.0\n)\n"
BROKEN_YAML = "openapi: 3.0.0\npaths: [\n"
TWICE_YAML = "swagger: '2.0'\npaths:\n  /a: {get: {}}\n  /a: {put: {}}\n"

SOURCES = {
    "dome/wire.go": GO, "dome/wire_test.go": GO_TEST, "cam/camera.py": PYTHON, "ui/panel.ts": TYPESCRIPT, "ui/knob.mjs": JAVASCRIPT, "log/NightLog.java": JAVA, "box/PlateBox.cs": CSHARP, "sky.proto": PROTO,
    "api/openapi.yaml": OPENAPI, "docs/darks.json": SWAGGER, "charts/pier/Chart.yaml": "version: 1\n", "charts/mast/Chart.yml": "name: Mast-headless\n", "charts/mast/values-lab.yaml": VALUES, "go.mod": GOMOD,
    "api/swagger-broken.yml": BROKEN_YAML, "api/swagger-twice.yml": TWICE_YAML, "notes.md": "# GET /nothing\n", "dome/wire.pb.go": GO, "ui/node_modules/x.ts": TYPESCRIPT,
}

#: What each file must give: kind and keys.
CONTRACTS = {
    "dome/wire.go": {
        "http_endpoint": ["GET /comets/{}/tail", "PUT /mirrors/{}", "DELETE /exposures/{}", "PATCH /exposures"],
        "http_client": ["HEAD /v2/plates", "POST /flats/{}/master", "DELETE /plates/{}", "PUT /darks"],
        "topic_producer": ["sky.clear", "focus.runs"], "topic_consumer": ["wind.gust", "seeing", "guide.stars"], "grpc_service": ["Tracker"], "grpc_client": ["Weather"],
        "config_key": ["DOME_KEY", "MAST_URL"], "data_entity": ["plates", "nights", "pointing"],
    },
    "cam/camera.py": {
        "http_endpoint": ["HEAD /plates/{}", "GET /nights/<night>", "POST /nights", "PUT /nights"], "http_client": ["PATCH /plates/{}/label", "DELETE /plates/{}", "GET /nights/{}"],
        "topic_producer": ["frame.ready"], "topic_consumer": ["calibration", "wind.gust", "sky.clear", "sky.cloud"], "grpc_client": ["Weather"], "grpc_service": ["Shutter"],
        "config_key": ["MAST_URL", "CAMERA_GAIN", "CAMERA_BIAS"], "data_entity": ["plates"],
    },
    "ui/panel.ts": {
        "http_endpoint": ["ALL /dials/{}", "OPTIONS /dials", "PUT /panels/{}"], "http_client": ["GET /plates/{}", "GET /nights/{}/log", "HEAD /", "DELETE /plates/{}"],
        "topic_producer": ["dial.turned", "focus.runs"], "topic_consumer": ["dial.turned", "frame.ready"], "grpc_client": ["Weather", "Tracker"], "config_key": ["PANEL_KEY", "MAST_URL"], "data_entity": ["panels"],
    },
    "ui/knob.mjs": {"http_endpoint": ["POST /knobs/{}"]},
    "log/NightLog.java": {
        "http_endpoint": ["PUT /nights/{}/notes", "DELETE /nights/notes", "GET /nights/search", "PATCH /nights/open", "GET /nights/entries"],
        "http_client": ["POST /plates", "GET /plates/{}", "DELETE /darks/{}", "OPTIONS /flats"], "grpc_service": ["Tracker", "Shutter"], "grpc_client": ["Weather", "Shutter"],
        "topic_producer": ["night.begun"], "topic_consumer": ["night.begun", "sky.clear", "sky.cloud"], "config_key": ["NIGHT_KEY", "MAST_URL"], "data_entity": ["nights"],
    },
    "box/PlateBox.cs": {
        "http_endpoint": ["PUT /plates/{}/label", "HEAD /plates/count", "PATCH /shelves/{}", "DELETE /boxes/{}", "PUT /boxes"], "http_client": ["DELETE /plates/{}", "GET /nights/{}", "PUT /darks/{}"],
        "topic_producer": ["plate.moved", "frame.ready"], "topic_consumer": ["night.begun"], "config_key": ["PLATE_KEY", "MAST_URL", "Box:Size"], "grpc_service": ["Tracker", "Shutter"], "grpc_client": ["Weather", "Shutter"],
        "data_entity": ["boxes"],
    },
    "sky.proto": {"schema": ["Weather", "Tracker"]},
    "api/openapi.yaml": {"http_endpoint": ["GET /plates/{}", "PUT /plates/{}", "TRACE /v2/nights"]},
    "docs/darks.json": {"http_endpoint": ["POST /darks/{}"]},
    "charts/pier/Chart.yaml": {"service": ["pier"]}, "charts/mast/Chart.yml": {"service": ["mast"]}, "charts/mast/values-lab.yaml": {"service_ref": ["vault", "redis", "mast", "panel"]},
    "go.mod": {"package_publish": ["example.org/dome"], "package_dep": ["example.org/sky", "example.org/units"]},
}

#: Declarations: (file, kind, names).
DECLARED = [
    ("dome/wire.go", "interface", "Shutter"), ("dome/wire.go", "class", "Motor Gear Ring"), ("dome/wire.go", "function", "Build tune settle wire"), ("dome/wire.go", "method", "Motor.Spin Motor.brake Gear.Spin Ring[T].Push"),
    ("dome/wire_test.go", "function", "TestIt"), ("cam/camera.py", "class", "Camera Device"), ("cam/camera.py", "function", "record plate night nights nothing"), ("cam/camera.py", "method", "Camera.expose Camera.cool"),
    ("ui/panel.ts", "interface", "Gauge"), ("ui/panel.ts", "class", "Panel Board"), ("ui/panel.ts", "function", "paint level"), ("ui/panel.ts", "method", "Panel.read Panel.scale Board.mount"),
    ("ui/knob.mjs", "class", "Knob"), ("ui/knob.mjs", "method", "Knob.turn Knob.click"), ("ui/knob.mjs", "function", "spin"),
    ("log/NightLog.java", "class", "NightLog Entry Phase Span ShutterService"), ("log/NightLog.java", "interface", "Journal"),
    ("log/NightLog.java", "method", "NightLog.write NightLog.wipe NightLog.search NightLog.open NightLog.stamp NightLog.one NightLog.two Entry.list Journal.write Span.size"),
    ("box/PlateBox.cs", "class", "PlateBox Slot Tag Shutters Loose"), ("box/PlateBox.cs", "interface", "IBox"), ("box/PlateBox.cs", "method", "PlateBox.Label PlateBox.Count PlateBox.Shelf PlateBox.Dust Slot.Read"),
]
IMPORTS = {
    "dome/wire.go": "os example.org/sky net/http", "cam/camera.py": "os json pipeline.flat .", "ui/panel.ts": "./dial axios", "log/NightLog.java": "java.util.List org.sky.Units", "box/PlateBox.cs": "System Sky.Units",
}
#: References that resolve: (rel, source declaration, target declaration), each as file::name.
REFERENCES = [
    ("calls", "dome/wire.go::Build", "dome/wire.go::tune"), ("calls", "dome/wire.go::tune", "dome/wire.go::settle"), ("calls", "dome/wire.go::Motor.Spin", "dome/wire.go::Motor.brake"),
    ("calls", "cam/camera.py::Camera.expose", "cam/camera.py::Camera.cool"), ("calls", "cam/camera.py::Camera.expose", "cam/camera.py::record"), ("calls", "cam/camera.py::nights", "cam/camera.py::plate"), ("inherits", "cam/camera.py::Camera", "cam/camera.py::Device"),
    ("calls", "ui/panel.ts::Panel.read", "ui/panel.ts::Panel.scale"), ("calls", "ui/panel.ts::Panel.read", "ui/panel.ts::level"), ("calls", "ui/panel.ts::paint", "ui/panel.ts::level"), ("calls", "ui/panel.ts::Board.mount", "ui/panel.ts::paint"),
    ("inherits", "ui/panel.ts::Panel", "ui/panel.ts::Board"), ("implements", "ui/panel.ts::Panel", "ui/panel.ts::Gauge"), ("calls", "ui/knob.mjs::Knob.turn", "ui/knob.mjs::Knob.click"), ("calls", "ui/knob.mjs::Knob.turn", "ui/knob.mjs::spin"),
    ("calls", "log/NightLog.java::NightLog.write", "log/NightLog.java::NightLog.stamp"), ("implements", "log/NightLog.java::NightLog", "log/NightLog.java::Journal"),
    ("calls", "box/PlateBox.cs::PlateBox.Label", "box/PlateBox.cs::PlateBox.Dust"), ("implements", "box/PlateBox.cs::PlateBox", "box/PlateBox.cs::IBox"),
]


def literal(value: object) -> str:
    if isinstance(value, float):
        return f"CAST({value} AS DOUBLE)"
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for a table of literals."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def files(spark: SparkSession, sources: dict[str, str], world: str = "obs") -> DataFrame:
    return spark.createDataFrame([(world, 0, rel, text) for rel, text in sources.items()], FILES)


def facts(spark: SparkSession, *rels: str) -> DataFrame:
    return fact_table(files(spark, {r: SOURCES[r] for r in rels} if rels else SOURCES))


def contract_rows(*rels: str) -> str:
    return values("rel, kind, key", [(r, k, n) for r in rels for k, names in CONTRACTS.get(r, {}).items() for n in names])


def contracts_of(*rels: str):
    return lambda spark, sf_dir: contracts(facts(spark, *rels)).select("rel", "kind", "key").distinct()


#: What a client, an endpoint and others record beside the key.
METADATA = [
    ("dome/wire.go", "http_client", "POST /flats/{}/master", {"method": "POST", "path": "/flats/{}/master", "url": 'base+"/flats/"+night+"/master"'}),
    ("dome/wire.go", "http_endpoint", "DELETE /exposures/{}", {"method": "DELETE", "path": "/exposures/:frame"}),
    ("dome/wire.go", "topic_consumer", "guide.stars", {"topic": "Guide.Stars"}), ("cam/camera.py", "config_key", "CAMERA_BIAS", {"env": "CAMERA_BIAS"}), ("cam/camera.py", "data_entity", "plates", {"table": "plates"}),
    ("api/openapi.yaml", "http_endpoint", "TRACE /v2/nights", {"method": "TRACE", "path": "/api/v2/nights", "source": "openapi"}), ("charts/pier/Chart.yaml", "service", "pier", {"source": "helm"}),
    ("charts/mast/values-lab.yaml", "service_ref", "vault", {"source": "helm-values"}), ("go.mod", "package_dep", "example.org/sky", {"source": "gomod"}),
    ("sky.proto", "schema", "Weather", {"methods": "Now Watch", "package": "sky.v1"}), ("ui/panel.ts", "grpc_client", "Tracker", None),
]


def _flat(found: dict | None) -> str:
    return ";".join(f"{k}={v}" for k, v in sorted((found or {}).items()))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    flat = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    wanted = spark.createDataFrame([r[:3] for r in METADATA], "rel string, kind string, key string")
    found = contracts(facts(spark)).select("rel", "kind", "key", flat.alias("metadata"))
    return found.join(F.broadcast(wanted), ["rel", "kind", "key"]).distinct()


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(facts(spark)).where(F.col("kind").isin("function", "method", "class", "interface"))
    return nodes.select("id", "kind", "name", F.coalesce(F.col("metadata")["receiver"], F.lit("")).alias("receiver"))


def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(facts(spark)).where("kind = 'file'")
    return nodes.select("id", "name", F.coalesce(F.col("metadata")["imports"], F.lit("")).alias("imports"))


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = stored(facts(spark), "facts")
    symbols = graph_nodes(of).where(F.col("kind").isin("function", "method", "class", "interface"))
    symbols = symbols.select("id", "world", "kind", F.when(F.col("kind") == "method", F.substring_index("name", ".", -1)).otherwise(F.col("name")).alias("lookup"))
    return unique_references(symbols, references(of))


# Two repositories on disk: listing, extraction, resolving, splitting and both documents.

REPOS = {
    "relay": {
        "cmd/mast/main.go": 'package main\nfunc main() { start() }\nfunc start() { mux.HandleFunc("GET /winds/{hour}", h); os.Getenv("RELAY_TOKEN"); pb.RegisterGustServer(s, x); bus.Publish("Wind.Gust", m) }\n',
        "cmd/server/main.go": 'package main\nfunc main() { db.Query("SELECT a FROM winds WHERE b") }\n',
        "charts/mast/Chart.yaml": "name: mast\n",
        "_private/__init__.py": "",
        ".github/ci.py": 'os.getenv("CI_TOKEN")\n',
        ".cache/x.py": 'os.getenv("LOST")\n',
        "vendor/y.go": 'package y\nfunc Y() { os.Getenv("LOST") }\n',
        "lib/start.go": "package lib\nfunc Use() { start() }\n",
    },
    "pier": {
        "app.py": 'requests.get(f"http://mast/winds/{hour}")\nos.getenv("RELAY_TOKEN")\nos.getenv("PORT")\nbus.subscribe("wind.gust")\ngust_grpc.GustStub(c)\nrun("SELECT a FROM winds WHERE b")\n',
        "values.yaml": "MAST_ADDR: mast:80\nDB_HOST: postgres\n",
        "_pb2.py": 'os.getenv("LOST")\n',
    },
}


def written(spark: SparkSession) -> list[tuple[str, str]]:
    """(world, directory) of REPOS, written to a new folder that the executors share."""
    folder = new_path(spark, "repos").removeprefix("file://")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for world, sources in REPOS.items():
        for rel, text in sources.items():
            at = jvm.org.apache.hadoop.fs.Path(f"file://{folder}/{world}/{rel}")
            out = jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            out.initialize(jvm.java.net.URI("file:///"), conf)
            stream = out.create(at)
            stream.write(bytearray(text.encode()))
            stream.close()
    return [(world, f"{folder}/{world}") for world in REPOS]


def resolved(spark: SparkSession, divided: bool = False) -> Graph:
    from orrery.cli import extracted

    return extracted(spark, written(spark), divided)


GUST, APP = "relay::cmd/mast/main.go", "pier::app.py"
CROSS = [
    (f"{APP}::http_client::GET /winds/{{}}", f"{GUST}::http_endpoint::GET /winds/{{}}", "http_call", "http", "GET /winds/{}", 0.85),
    (f"{APP}::grpc_client::Gust", f"{GUST}::grpc_service::Gust", "grpc_call", "grpc", "Gust", 0.9),
    (f"{GUST}::topic_producer::wind.gust", f"{APP}::topic_consumer::wind.gust", "publishes_to", "pubsub", "wind.gust", 0.8),
    ("pier::values.yaml::service_ref::mast", "relay::charts/mast/Chart.yaml::service::mast", "connects_to", "k8s", "mast", 0.8),
    (f"{APP}::config_key::RELAY_TOKEN", f"{GUST}::config_key::RELAY_TOKEN", "reads_config", "config", "RELAY_TOKEN", 0.7),
    (f"{APP}::data_entity::winds", "relay::cmd/server/main.go::data_entity::winds", "shares_table", "db", "winds", 0.75),
]
NODES = [
    *[(f"relay::{r}", "file") for r in ("cmd/mast/main.go", "cmd/server/main.go", "charts/mast/Chart.yaml", "_private/__init__.py", ".github/ci.py", "lib/start.go")], *[(f"pier::{r}", "file") for r in ("app.py", "values.yaml")],
    (f"{GUST}::main", "function"), (f"{GUST}::start", "function"), (f"{GUST}::http_endpoint::GET /winds/{{}}", "http_endpoint"), (f"{GUST}::config_key::RELAY_TOKEN", "config_key"), (f"{GUST}::grpc_service::Gust", "grpc_service"),
    (f"{GUST}::topic_producer::wind.gust", "topic_producer"), ("relay::cmd/server/main.go::main", "function"), ("relay::cmd/server/main.go::data_entity::winds", "data_entity"), ("relay::charts/mast/Chart.yaml::service::mast", "service"),
    ("relay::.github/ci.py::config_key::CI_TOKEN", "config_key"), ("relay::lib/start.go::Use", "function"),
    *[(f"{APP}::{k}", k.split("::")[0]) for k in ("http_client::GET /winds/{}", "config_key::RELAY_TOKEN", "config_key::PORT", "topic_consumer::wind.gust", "grpc_client::Gust", "data_entity::winds")],
    ("pier::values.yaml::service_ref::mast", "service_ref"), ("pier::values.yaml::service_ref::postgres", "service_ref"),
]
CALLS = [(f"{GUST}::main", f"{GUST}::start", "calls"), ("relay::lib/start.go::Use", f"{GUST}::start", "calls")]
EDGES = [*[("::".join(i.split("::")[:2]), i, "contains") for i, k in NODES if k != "file"], *CALLS]


def moved(name: str) -> str:
    """An id after the split: what lies under cmd/mast and charts/mast is a world of its own."""
    return "mast" + name.removeprefix("relay") if name.startswith(("relay::cmd/mast/", "relay::charts/mast/")) else name


def graph_table(part: str, columns: str, divided: bool = False):
    return lambda spark, sf_dir: getattr(resolved(spark, divided), part).select(*columns.split(", "))


# Graphs of which the report is known.

CONTROLS = {
    "triangles": [*combinations("abc", 2), *combinations("def", 2), ("c", "d")],
    "complete": list(combinations("abcdef", 2)),
    "star": [("h", x) for x in "abc"],
    "pair": [("x", "y")],
    "none": [],
}
REPORTS = [
    ("triangles", "c:3,d:3,a:2,b:2,e:2,f:2", "a b c|d e f", 0.3571, 7, 0.4667, False), ("complete", "a:5,b:5,c:5,d:5,e:5,f:5", "a b c d e f", 0.0, 15, 1.0, True),
    ("star", "h:3,a:1,b:1,c:1", "a b c h", 0.0, 3, 0.5, True), ("pair", "x:1,y:1", "x y", 0.0, 1, 1.0, False), ("none", "a:0,b:0", "a|b", 0.0, 0, 0.0, False),
]


def control_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, pairs in CONTROLS.items():
        worlds = sorted({w for p in pairs for w in p} or {"a", "b"})
        nodes = spark.createDataFrame([(f"{w}::n", w) for w in worlds], "id string, world string")
        edges = spark.createDataFrame([(f"{a}::n", f"{b}::n", "http") for a, b in pairs], "src string, dst string, protocol string")
        report = gravity.report(nodes, edges)
        masses = F.array_join(F.transform("worlds", lambda w: F.concat(w["world"], F.lit(":"), w["mass"].cast("int").cast("string"))), ",")
        groups = F.array_join(F.transform("galaxies", lambda g: F.array_join(g, " ")), "|")
        row = report.select(F.lit(name).alias("graph"), masses.alias("masses"), groups.alias("galaxies"), "modularity", "pair_edges", "density", "black_hole")
        out = row if out is None else out.union(row)
    return out


DOCUMENT_REPOS = {"one": {"a.py": 'os.getenv("SHARED_KEY")\ndef f(): pass\n'}, "two": {"b.py": 'os.getenv("SHARED_KEY")\n'}}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's document and the report's, as text."""
    rows = [(w, k, rel, text) for k, (w, sources) in enumerate(DOCUMENT_REPOS.items()) for rel, text in sources.items()]
    of = stored(fact_table(spark.createDataFrame(rows, FILES)), "facts")
    nodes = stored(graph_nodes(of), "nodes")

    worlds = spark.createDataFrame([(w,) for w in DOCUMENT_REPOS], "world string")
    meta = spark.createDataFrame([("one", "https://example.org/one.git?a=1&b=2", "main")], "world string, repo_origin string, ref string")
    graph = Graph(nodes, contains_edges(nodes), resolve(nodes), worlds, worlds, meta)
    report = gravity_json(gravity.report(graph.nodes, graph.cross_edges, worlds))
    return spark.createDataFrame([("graph", graph_json(graph)), ("gravity", report + "\n")], "document string, content string")


def _document_rows() -> list[tuple]:
    node = lambda w, rel, kind="", name="", **metadata: {"id": "::".join(x for x in (w, rel, kind if kind == "config_key" else "", name) if x), "world": w, "kind": kind or "file", "name": name or rel} | ({"metadata": metadata} if metadata else {})
    nodes = [node("one", "a.py"), node("one", "a.py", "function", "f"), node("one", "a.py", "config_key", "SHARED_KEY", env="SHARED_KEY"), node("two", "b.py"), node("two", "b.py", "config_key", "SHARED_KEY", env="SHARED_KEY")]
    edges = [{"src": "one::a.py", "dst": "one::a.py::config_key::SHARED_KEY", "rel": "contains"}, {"src": "one::a.py", "dst": "one::a.py::f", "rel": "contains"}, {"src": "two::b.py", "dst": "two::b.py::config_key::SHARED_KEY", "rel": "contains"}]
    cross = [{"src": "one::a.py::config_key::SHARED_KEY", "dst": "two::b.py::config_key::SHARED_KEY", "rel": "reads_config", "protocol": "config", "contract_key": "SHARED_KEY", "confidence": 0.7}]
    meta = {"one": {"repo_origin": "https://example.org/one.git?a=1\\u0026b=2", "ref": "main"}}
    graph = {"worlds": ["one", "two"], "nodes": nodes, "edges": edges, "cross_edges": cross, "world_meta": meta}
    report = {"worlds": [{"world": "one", "mass": 1.5}, {"world": "two", "mass": 1.5}], "galaxies": [["one", "two"]], "modularity": 0.0, "pair_edges": 1, "density": 1.0, "black_hole": False}
    dump = lambda x: json.dumps(x, indent=2).replace("\\\\u0026", "\\u0026") + "\n"
    return [("graph", dump(graph)), ("gravity", dump(report))]


URLS = [
    ("http://h/x", "/x"), ("https://ann:pw@h:8080/x%20y?q", "/x y"), ("http://ann@h", "/"), ("http://h:80a/x", ""), ("http://a:b@h:p/x", ""), ("http://[::1]:80/z", "/z"), ("http://[::1]:8o/z", ""), ("http://h:/x#f", "/x"),
    ("/plain?q=1", "/plain?q=1"), ("ftp://h/x", ""), ("http://h/%zz", ""), ("http://{h}/x", ""), ("relative", ""),
]


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u, _ in URLS], "url string").select("url", S.url_path(F.col("url")).alias("path"))


TYPES = [("IBox", True), ("Ibex", False), ("I", False), ("IO", True), ("Box", False), ("iBox", False)]


def interface_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t, _ in TYPES], "name string").select("name", S.is_csharp_interface(F.col("name")).alias("interface"))


PATHS = [("/srv/dome", "dome"), ("/srv/dome/", "dome"), ("repos/../pier", "pier"), ("./mast", "mast"), ("/a/b/./c//", "c")]


def world_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, world_name(p)) for p, _ in PATHS], "path string, world string")


def split_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A hand-made graph with edges over the border of a service root."""
    nodes = spark.createDataFrame([(f"r::{x}", "r", "file", x) for x in SPLIT_FILES], "id string, world string, kind string, name string")
    edges = spark.createDataFrame([("r::cmd/lens/a.go", "r::lib/x.go", "calls"), ("r::lib/x.go", "r::cmd/lens/a.go", "calls"), ("r::lib/x.go", "r::lib/x.go", "calls")], "src string, dst string, rel string")
    cross = spark.createDataFrame([("r::cmd/lens/a.go", "s::y.go", "http_call", "http", "GET /x", 0.85), ("s::y.go", "r::charts/lens/Chart.yaml", "connects_to", "k8s", "lens", 0.8)], "src string, dst string, rel string, protocol string, contract_key string, confidence double")
    dirs = spark.createDataFrame([("r", d) for d in ("cmd", "cmd/lens", "cmd/stray", "cmd/Main", "charts", "charts/lens", "lib")], "world string, dir string")
    return split.split_worlds(nodes, edges, cross, dirs)


SPLIT_FILES = ["cmd/lens/a.go", "cmd/stray/b.go", "cmd/Main/c.go", "charts/lens/Chart.yaml", "lib/x.go"]
SPLIT_ROWS = [
    *[("node", "r::" + f, ("lens::" if "/lens/" in f else "r::") + f, "lens" if "/lens/" in f else "r") for f in SPLIT_FILES],
    ("edge", "calls", "lens::cmd/lens/a.go", "r::lib/x.go"), ("edge", "calls", "r::lib/x.go", "lens::cmd/lens/a.go"), ("edge", "calls", "r::lib/x.go", "r::lib/x.go"),
    ("cross", "http_call", "lens::cmd/lens/a.go", "s::y.go"), ("cross", "connects_to", "s::y.go", "lens::charts/lens/Chart.yaml"),
]


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, cross = split_graph(spark)
    out = nodes.select(F.lit("node").alias("part"), F.concat(F.lit("r::"), "name").alias("what"), F.col("id").alias("a"), F.col("world").alias("b"))
    return out.union(edges.select(F.lit("edge"), "rel", "src", "dst")).union(cross.select(F.lit("cross"), "rel", "src", "dst"))


STRUCTURED = [r for r in SOURCES if r.endswith((".yaml", ".yml", ".json", ".proto", "go.mod"))]
LISTED_FILES = ["dome/wire.go", "dome/wire_test.go", "cam/camera.py", "ui/panel.ts", "ui/knob.mjs", "log/NightLog.java", "box/PlateBox.cs", "sky.proto", "api/openapi.yaml", "docs/darks.json", "charts/pier/Chart.yaml", "charts/mast/Chart.yml", "charts/mast/values-lab.yaml", "go.mod"]


def _receiver(kind: str, name: str) -> str:
    return name.rsplit(".", 1)[0] if kind == "method" else ""


#: name: (query, SQL)
CORPUS_QUERIES = {
    "q27_go_contracts": (contracts_of("dome/wire.go", "dome/wire_test.go", "dome/wire.pb.go"), contract_rows("dome/wire.go")),
    "q28_python_contracts": (contracts_of("cam/camera.py"), contract_rows("cam/camera.py")),
    "q29_script_contracts": (contracts_of("ui/panel.ts", "ui/knob.mjs", "ui/node_modules/x.ts"), contract_rows("ui/panel.ts", "ui/knob.mjs")),
    "q30_java_contracts": (contracts_of("log/NightLog.java"), contract_rows("log/NightLog.java")),
    "q31_csharp_contracts": (contracts_of("box/PlateBox.cs"), contract_rows("box/PlateBox.cs")),
    "q32_structured_contracts": (contracts_of(*STRUCTURED), contract_rows(*STRUCTURED)),
    "q33_contract_metadata": (metadata, values("rel, kind, key, metadata", [(*r[:3], _flat(r[3])) for r in METADATA])),
    "q34_declarations": (declarations, values("id, kind, name, receiver", [(f"obs::{f}::{n}", k, n, _receiver(k, n)) for f, k, names in DECLARED for n in names.split()])),
    "q35_files_and_imports": (file_nodes, values("id, name, imports", [(f"obs::{r}", r, IMPORTS.get(r, "")) for r in LISTED_FILES])),
    "q36_reference_edges": (resolved_references, values("src, dst, rel", [(f"obs::{a}", f"obs::{b}", rel) for rel, a, b in REFERENCES])),
    "q37_scanned_nodes": (graph_table("nodes", "id, kind"), values("id, kind", NODES)),
    "q38_scanned_edges": (graph_table("edges", "src, dst, rel"), values("src, dst, rel", EDGES)),
    "q39_resolved_cross_edges": (graph_table("cross_edges", "src, dst, rel, protocol, contract_key, confidence"), values("src, dst, rel, protocol, contract_key, confidence", CROSS)),
    "q40_split_nodes": (graph_table("nodes", "id, world", True), values("id, world", [(moved(i), moved(i).split("::")[0]) for i, _ in NODES])),
    "q41_split_edges": (graph_table("edges", "src, dst, rel", True), values("src, dst, rel", [(moved(a), moved(b), r) for a, b, r in EDGES])),
    "q42_split_remaps_edges": (split_rows, values("part, what, a, b", SPLIT_ROWS)),
    "q43_control_reports": (control_reports, values("graph, masses, galaxies, modularity, pair_edges, density, black_hole", REPORTS)),
    "q44_documents": (documents, values("document, content", _document_rows())),
    "q45_url_paths": (url_paths, values("url, path", URLS)),
    "q46_interface_names": (interface_names, values("name, interface", TYPES)),
    "q47_world_names": (world_names, values("path, world", PATHS)),
}


