"""The two searches as tools with names and parameters, and a command line for them.

Called as a tool, parameters get their types and defaults checked; called raw, as the command line
does, they are taken as they come: no topN is all, and the text "false" is true.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import embed, search
from quern.sources import schema_json, vecstore
from quern.sources.model_files import MODEL, VOCABULARY, ModelFiles
from quern.streaming import refresh

REQUIRED = object()
VERSION = "0.1.0"


@dataclass
class Parameter:
    kind: type | tuple
    default: Any = REQUIRED
    description: str = ""


@dataclass
class Tool:
    title: str
    description: str
    parameters: dict[str, Parameter]
    handler: Callable[..., DataFrame]
    read_only: bool = True

    def checked(self, given: dict[str, Any]) -> dict[str, Any]:
        """The parameters with defaults; TypeError for a wrong or missing one. Unknown ones are dropped."""
        out = {}
        for name, p in self.parameters.items():
            if given.get(name) is None:
                if p.default is REQUIRED:
                    raise TypeError(f"{name} is required")
                out[name] = p.default
                continue
            if not isinstance(given[name], p.kind) or isinstance(given[name], bool) and p.kind is not bool:
                raise TypeError(f"{name} has the wrong type")
            out[name] = given[name]
        return out


class Engine:
    """Both searches over one session. Catalogs are kept by path."""

    def __init__(self, spark: SparkSession, store: DataFrame | Callable[[], DataFrame] | None = None, vocab: dict[str, int] | None = None, model: Callable[[], embed.Model] | None = None, files: ModelFiles | None = None, repair: Callable[[], object] | None = None, offline: bool | None = None, refresh_ms: str | None = None) -> None:
        self.spark, self._store, self.vocab, self.model, self.files = spark, store, vocab, model, files
        self.repair, self.refresh_ms = repair or (lambda: None), refresh_ms
        self.offline = os.environ.get("QUERN_OFFLINE") == "true" if offline is None else offline
        self.catalogs: dict[str, refresh.Catalog] = {}
        self.tools: dict[str, Tool] = {
            "search_model": Tool("Search schema definitions", "Definitions of a project with elements, annotations and endpoints, by fuzzy name.", {"projectPath": Parameter(str, description="Folder of the compiled schema"), "name": Parameter(str, None, "Name, matched fuzzily"), "kind": Parameter(str, None, "Kind to keep"), "topN": Parameter((int, float), 1, "Most results"), "namesOnly": Parameter(bool, False, "Names alone")}, self.search_model),
            "search_docs": Tool("Search documentation", "Text chunks nearest to a query.", {"query": Parameter(str, description="What to look for"), "maxResults": Parameter((int, float), 10, "Most results")}, self.search_docs),
        }

    def catalog(self, path: str) -> refresh.Catalog:
        if path not in self.catalogs:
            self.catalogs[path] = refresh.Catalog(self.spark, lambda: schema_json.build(schema_json.read_definitions(self.spark, path)), lambda: schema_json.schema_files(self.spark, os.path.dirname(path) if os.path.isfile(path) else path, "json"), self.refresh_ms)
        return self.catalogs[path]

    def search_model(self, projectPath: str, name: str | None = None, kind: str | None = None, topN: object = None, namesOnly: object = False) -> DataFrame:
        """(name) or (name, kind, body, endpoints, exposed_entities), best first."""
        found = search.fuzzy_top_n(search.of_kind(self.catalog(projectPath).get(), kind), name or "", topN)
        return found.select("name") if namesOnly else found.select("name", "kind", "body", "endpoints", "exposed_entities")

    def ranked_docs(self, query: str, maxResults: object = 10) -> DataFrame:
        if self._store is None or self.vocab is None or self.model is None:
            raise ValueError("search_docs needs a store, a vocabulary and a model")

        def find() -> DataFrame:
            store = self._store() if callable(self._store) else self._store
            # A model that fails is fetched anew, once, and the same query goes through it.
            q = embed.self_healing(lambda: embed.embed_one(self.spark, query, self.vocab, self.model), self.renew_model, self.offline)
            return search.search_vectors(store, q, maxResults, norm="norm" if "norm" in store.columns else None)

        return refresh.with_retry(find, self.repair, offline=self.offline)

    def load_model(self) -> None:
        """Vocabulary and model from the model's files."""

        def read(f: ModelFiles) -> None:
            self.vocab, self.model = schema_json.read_vocabulary(self.spark, f.path(VOCABULARY)), embed.onnx_model(f.path(MODEL))
            self.model()  # a broken file shows here

        self.files.load(read)

    def renew_model(self) -> None:
        if self.files:
            self.files.renew()
            self.load_model()

    def warm(self) -> None:
        """Fetches and loads ahead what the first search of documents would wait for; offline nothing."""
        if not self.offline:
            if self.files:
                self.load_model()
            if callable(self._store):
                refresh.with_retry(self._store, self.repair)

    def search_docs(self, query: str, maxResults: object = 10) -> DataFrame:
        """One row, text: the chunks nearest to the query, best first."""
        return search.joined_text(self.ranked_docs(query, maxResults), search.similarity_order("ord"))

    def call_tool(self, tool: str, params: dict[str, Any], raw: bool = False) -> DataFrame:
        if tool not in self.tools:
            raise KeyError(f"no tool {tool}; there are: {', '.join(self.tools)}")
        t = self.tools[tool]
        return t.handler(**({k: v for k, v in params.items() if k in t.parameters} if raw else t.checked(params)))

    def call_text(self, tool: str, params: dict[str, Any]) -> str:
        """The result as text, or the error's message."""
        try:
            return render(self.call_tool(tool, params))
        except Exception as e:
            return str(e)


def input_schema(tool: Tool) -> dict[str, Any]:
    names = {str: "string", bool: "boolean", (int, float): "number"}
    each = {n: {"type": names[p.kind], "description": p.description, **({} if p.default in (REQUIRED, None) else {"default": p.default})} for n, p in tool.parameters.items()}
    return {"type": "object", "properties": each, "required": [n for n, p in tool.parameters.items() if p.default is REQUIRED]}


def answer(engine: Callable[[], Engine], request: Any) -> dict[str, Any] | None:
    """The JSON-RPC reply to a request; None to a notification."""
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    method, params, id = request["method"], request.get("params") or {}, request.get("id")
    if "id" not in request:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": id}
    if method == "initialize":
        return {**reply, "result": {"protocolVersion": params.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quern", "version": VERSION}}}
    if method == "ping":
        return {**reply, "result": {}}
    if method == "tools/list":
        tools = [{"name": n, "title": t.title, "description": t.description, "inputSchema": input_schema(t), "annotations": {"readOnlyHint": t.read_only}} for n, t in engine().tools.items()]
        return {**reply, "result": {"tools": tools}}
    if method == "tools/call":
        if params.get("name") not in engine().tools:
            return {**reply, "error": {"code": -32602, "message": f"no tool {params.get('name')}"}}
        return {**reply, "result": {"content": [{"type": "text", "text": engine().call_text(params["name"], params.get("arguments") or {})}]}}
    return {**reply, "error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: Callable[[], Engine], requests: Iterable[str], out: TextIO) -> None:
    """Answers JSON-RPC requests, one a line, until they end. Errors of a tool are its text."""
    for line in requests:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def render(df: DataFrame, indent: int | None = None) -> str:
    """A text result as it is, names as a JSON list, other rows as a list of JSON objects."""
    if df.columns == ["text"]:
        return df.first()[0]
    if df.columns == ["name"]:
        return json.dumps([r[0] for r in df.collect()], indent=indent, ensure_ascii=False)
    rows = df.select(*[F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in df.dtypes]).collect()
    out = []
    for r in rows:
        d = r.asDict(recursive=True)
        body = json.loads(d.pop("body")) if d.get("body") else {}
        d = {"endpoints" if k == "endpoints" else "exposedEntities" if k == "exposed_entities" else k: v for k, v in d.items() if v is not None}
        out.append({**body, **d})
    return json.dumps(out, indent=indent, ensure_ascii=False)


def positional(tool: Tool, args: list[str]) -> dict[str, str]:
    """Arguments by the order of the parameters; surplus ones are dropped."""
    return dict(zip(tool.parameters, args))


def main(argv: list[str] | None = None, engine: Callable[[], Engine] | None = None, update: Callable[[], refresh.Download] | None = None, requests: Iterable[str] | None = None) -> int:
    """quern [--offline] [--version] [--download] [tool] [arguments]; without a tool it serves both over stdin and stdout."""
    parser = argparse.ArgumentParser("quern", description="Search schema definitions and documentation.", exit_on_error=False)
    parser.add_argument("-v", "--version", action="store_true")
    parser.add_argument("--download", "--download-embeddings", action="store_true", help="bring the vector store up to date")
    parser.add_argument("--offline", action="store_true", help="no downloads")
    parser.add_argument("tool", nargs="?")
    parser.add_argument("args", nargs="*")
    try:
        a, rest = parser.parse_known_args(argv)
        if rest:
            raise argparse.ArgumentError(None, f"unknown: {' '.join(rest)}")
    except argparse.ArgumentError as e:
        print(e, parser.format_help(), sep="\n", file=sys.stderr)
        return 1
    if a.version:
        print(VERSION)
        return 0
    if a.download:
        if a.offline or a.tool or update is None:
            print("--download stands alone", file=sys.stderr)
            return 1
        done = update()
        print(json.dumps({"etag": done.etag, "updated": done.updated}))
        return 0
    held: list[Engine] = []

    def start() -> Engine:
        if not held:
            held.append(engine() if engine else Engine(SparkSession.builder.getOrCreate()))
            held[0].offline = held[0].offline or a.offline
        return held[0]

    if not a.tool:
        serve(start, sys.stdin if requests is None else requests, sys.stdout)
        return 0
    e = start()
    if a.tool not in e.tools:
        print(f"no tool {a.tool}; there are: {', '.join(e.tools)}", file=sys.stderr)
        return 1
    try:
        print(render(e.call_tool(a.tool, positional(e.tools[a.tool], a.args), raw=True), indent=2))
        return 0
    except Exception as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
