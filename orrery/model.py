"""Schemas and closed vocabularies of the code graph."""

from __future__ import annotations

NODES = "id string, world string, kind string, name string, metadata map<string,string>, rel_path string, seq int"
EDGES = "src string, dst string, rel string"
CROSS_EDGES = "src string, dst string, rel string, protocol string, contract_key string, confidence double"
FILES = "world string, repo_ord int, rel string, path string"

#: What a directed pairing joins, and how sure it is. Only publishing points from its producer.
PAIRINGS = [
    # producer kind, consumer kind, rel, protocol, confidence, source is producer
    ("http_endpoint", "http_client", "http_call", "http", 0.85, False),
    ("grpc_service", "grpc_client", "grpc_call", "grpc", 0.9, False),
    ("topic_producer", "topic_consumer", "publishes_to", "pubsub", 0.8, True),
    ("service", "service_ref", "connects_to", "k8s", 0.8, False),
    ("package_publish", "package_dep", "depends_on", "package", 0.95, False),
]
#: Kinds that link worlds that share a key.
SYMMETRIC = [("config_key", "reads_config", "config", 0.7), ("data_entity", "shares_table", "db", 0.75)]
MOST_WORLDS = 6

#: Weight of a cross edge by protocol; any other weighs 1.
WEIGHTS = {"http": 1.0, "grpc": 1.0, "pubsub": 0.5, "schema": 2.0, "db": 3.0, "config": 1.5, "package": 1.5, "k8s": 2.0}

#: Kinds that a reference may resolve to.
ACCEPTS = [("calls", "function"), ("calls", "method"), ("inherits", "class"), ("implements", "interface")]

#: Keys that link nothing.
HTTP_NOISE = "/ /health /healthz /ping /ready /readyz /live /livez /metrics /status /version /favicon.ico".split()
INFRA_NAMES = (
    "redis postgres postgresql mysql mariadb mongo mongodb cassandra kafka nats rabbitmq memcached etcd vault consul"
    " zookeeper elasticsearch opensearch prometheus grafana jaeger localhost db cache database queue"
).split()
GENERIC_NAMES = "grpc gateway runner common web api proxy lib libs core shared util utils base internal pkg sdk tools".split()
CONFIG_NOISE = (
    "PORT HOST HOSTNAME ADDR ADDRESS PATH HOME PWD USER LANG TERM TZ SHELL DEBUG VERBOSE ENV ENVIRONMENT NODE_ENV"
    " LOG_LEVEL LOGLEVEL GOPATH GOROOT COLLECTOR_SERVICE_ADDR ENABLE_PROFILER DISABLE_PROFILER"
).split()
TABLE_NOISE = "information_schema pg_catalog sqlite_master migrations schema_migrations".split()
GRPC_NON_SERVICES = ["", *"HTTP Http Redis S3 SQL DB Grpc GRPC Mongo Kafka AWS GCP OAuth2 Default".split()]

#: Where files are looked for and how they are told apart.
SKIPPED_DIRS = ".git node_modules vendor .idea .vscode dist build __pycache__".split()
GENERATED = ".pb.go .pb.gw.go .pb.validate.go .connect.go .gen.go _generated.go _pb2.py _pb2_grpc.py .pb.ts _pb.ts .pb.js _pb.js".split()
LANGUAGES = {
    ".go": "go", ".proto": "protobuf", ".py": "python", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".java": "java", ".cs": "csharp",
}
TEST_DIRS = "testdata __tests__ __mocks__".split()
GENERIC_ROOTS = "server main app cmd cli test tester tests tool tools e2e integration migrate migration".split()
HTTP_VERBS = "get post put delete patch head options trace".split()
