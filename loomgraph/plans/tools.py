"""The named tools over a graph, as a caller by name and arguments sees them, and a line shell for managing graphs."""
from __future__ import annotations

import shlex
from collections.abc import Callable
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import analytics, mutate, search, traverse
from loomgraph.plans.graph import CodeGraph
from loomgraph.sources import repository as trees


class Tools:
    """Holds the current graph; call(name, ...) checks the arguments and gives a lazy DataFrame.

    Every tool takes repository; arguments without a default are required and
    may not be empty. delete_repository replaces the graph and returns the
    repositories left.
    """

    def __init__(self, graph: CodeGraph):
        self.graph = graph
        g = lambda f: lambda repository, *a: f(self.graph, repository, *a)
        need = ...  # a required argument
        #: name: what runs, and its arguments after repository with their defaults.
        self.tools: dict[str, tuple[Callable[..., DataFrame], dict]] = {
            "find_function": (g(search.find_function), {"name": need}),
            "find_file": (g(search.find_file), {"pattern": need}),
            "search_code_names": (g(search.search_names), {"query": need, "limit": 10}),
            "search_code": (g(search.search_code), {"query": need, "limit": 10}),
            "get_callers": (g(traverse.callers), {"name": need, "depth": 1}),
            "get_callees": (g(traverse.callees), {"name": need, "depth": 1}),
            "get_class_hierarchy": (g(traverse.hierarchy), {"name": need, "direction": "both", "depth": 1}),
            "get_dependencies": (g(traverse.dependencies), {"name": need, "depth": 1}),
            "get_references": (g(traverse.references), {"name": need}),
            "get_repo_map": (g(analytics.repo_map), {}),
            "get_file_overview": (g(analytics.file_overview), {"path": need}),
            "get_symbol_context": (g(analytics.symbol_context), {"name": need}),
            "read_source": (g(analytics.read_source), {"names": need}),
            "delete_repository": (self._delete, {}),
            "get_repository_stats": (g(analytics.repository_stats), {}),
            "find_dead_code": (g(analytics.dead_code), {"exclude_decorated": False, "exclude_patterns": "", "limit": 50}),
            "calculate_cyclomatic_complexity": (g(analytics.complexity_of), {"name": need}),
            "find_most_complex_functions": (g(analytics.most_complex), {"limit": 10, "min_complexity": 5}),
            "find_call_chain": (self._chain, {"source_function": need, "target_function": need, "max_depth": traverse.MAX_CHAIN}),
        }

    def names(self) -> list[str]:
        return sorted(self.tools)

    def call(self, tool: str, repository: str, **arguments) -> DataFrame:
        if tool not in self.tools:
            raise ValueError(f"unknown tool {tool!r}")
        run, known = self.tools[tool]
        if strange := sorted(set(arguments) - set(known)):
            raise ValueError(f"{tool} takes no {', '.join(strange)}")
        given = {k: v if (v := arguments.get(k)) is not None else default for k, default in known.items()}
        for name, value in {"repository": repository, **given}.items():
            if value is ... or (value == "" and known.get(name, ...) is ...) or value is None:
                raise ValueError(f"{name} is required")
        return run(repository, *given.values())

    def _delete(self, repository: str) -> DataFrame:
        self.graph = mutate.delete_repository(self.graph, repository)
        return analytics.list_repositories(self.graph)

    def _chain(self, repository: str, source: str, target: str, max_depth: int) -> DataFrame:
        """Between the first functions of the two names, by path; a name without a function stands for itself and is not found."""
        named = self.graph.nodes("Function").where(F.col("repo") == repository)
        ends = []
        for name in (source, target):
            hit = named.where(F.col("name") == name).orderBy("path", "id").select("id").first()
            ends.append(hit["id"] if hit else name)
        return traverse.call_chain(self.graph, repository, *ends, max_depth)


class Trace:
    """Appends sectioned records, stamped in UTC, to a text file; usable wherever a callable of (section, text) is asked for."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, section: str, text: str) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"=== {section} {datetime.now(UTC).isoformat(timespec='seconds')} ===\n{text}\n")


HELP = "ingest PATH NAME | list | status | delete NAME | help | quit"


class Shell:
    """Commands over ingested repositories; say(stage, message) is told how far an ingest has come.

    With store, graphs are written there, a folder a repository, and read back.
    """

    def __init__(self, spark: SparkSession, out: TextIO, say: Callable[[str, str], None] | None = None, store: str | None = None):
        self.spark, self.out, self.say, self.store = spark, out, say or (lambda stage, message: None), store
        self.graphs: dict[str, Tools] = {}

    def run(self, lines) -> None:
        """Reads commands until the lines end or one is quit; a failing command is reported and the next one read."""
        for line in lines:
            try:
                command, *args = shlex.split(line) or [""]
                if command == "quit":
                    return
                if command:
                    self.command(command, args)
            except (ValueError, OSError) as e:
                print(f"error: {e}", file=self.out)

    def command(self, command: str, args: list[str]) -> None:
        if command == "help":
            print(HELP, file=self.out)
        elif command == "status":
            print(f"{len(self.graphs)} repositories, Spark {self.spark.version}", file=self.out)
        elif command == "list":
            for name in sorted(self.graphs):
                print(name, file=self.out)
        elif command == "ingest":
            if len(args) != 2:
                raise ValueError("ingest takes a path and a name")
            self.say("index", args[0])
            graph = trees.ingest(self.spark, args[0], args[1], self.store and f"{self.store}/{args[1]}")
            self.say("analyze", args[1])
            counts = {r["type"]: r["n"] for r in analytics.repository_stats(graph, args[1]).collect()}
            self.graphs[args[1]] = Tools(graph)
            self.say("done", args[1])
            print(", ".join(f"{n} {kind}" for kind, n in sorted(counts.items())), file=self.out)
        elif command == "delete":
            if len(args) != 1:
                raise ValueError("delete takes a name")
            if args[0] not in self.graphs:
                raise ValueError(f"no repository {args[0]!r}")
            del self.graphs[args[0]]
            print(f"deleted {args[0]}", file=self.out)
        else:
            print(f"unknown command {command!r}; try help", file=self.out)
