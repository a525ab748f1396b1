"""The model-driven loop: a model writes code against the graph until it gives a final answer."""
from __future__ import annotations

import contextlib
import io
import logging
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from loomgraph.functions.names import code_blocks, final_answer, is_identifier

log = logging.getLogger(__name__)

#: A model is any callable from (system, messages) to text.
Model = Callable[[str, list[dict]], str]

PROMPT = """You answer questions about a property graph by writing Python in blocks fenced as ```repl.
Call graph_metadata(), graph_search(query, labels, limit), graph_neighbors(id, edge_type, limit), graph_get_node(id),
graph_shortest_path(a, b, max_hops), graph_sql(text) and model_query(text); print what you want to see.
End with FINAL(answer), or FINAL_VAR(name) for the value of a variable.

The graph has {nodes} nodes and {edges} edges.
Labels: {labels}
Edge types: {types}"""


class KnowledgeGraph(Protocol):
    """What the loop needs of a graph."""

    def metadata(self) -> DataFrame: ...
    def search(self, query: str, labels: list[str] | None = None, limit: int = 20) -> DataFrame: ...
    def get_node(self, ident: str) -> DataFrame: ...
    def neighbors(self, ident: str, rel_type: str | None = None, limit: int = 50): ...
    def shortest_path(self, source: str, target: str, max_hops: int | None = None) -> DataFrame: ...
    def sql(self, query: str, args: dict | None = None) -> DataFrame: ...


def prompt(graph: KnowledgeGraph) -> str:
    """The system prompt; metadata has a row a label and type, so little is collected."""
    rows = graph.metadata().collect()
    pick = lambda what: ", ".join(f"{r['name']} ({r['n']})" for r in sorted(rows, key=lambda r: r["name"]) if r["what"] == what)
    total = {r["what"]: r["n"] for r in rows if not r["name"]}
    return PROMPT.format(nodes=total.get("nodes", 0), edges=total.get("edges", 0), labels=pick("label"), types=pick("type"))


def truncated(text: str, n: int) -> str:
    """The first and last half of a text of over n characters."""
    if len(text) <= n:
        return text
    half = n // 2
    return f"{text[:half]}\n... [truncated, {len(text)} total chars] ...\n{text[-half:] if half else ''}"


class Engine:
    """Runs the loop; rows shown to the model are bounded by `rows`, output by `output_chars`, turns by `turns`."""

    def __init__(self, graph: KnowledgeGraph, model: Model, turns: int = 30, output_chars: int = 1000, rows: int = 50):
        if graph is None or model is None:
            raise ValueError("graph and model are required")
        self.graph, self.model = graph, model
        self.turns, self.output_chars, self.rows = turns if turns > 0 else 30, output_chars if output_chars > 0 else 1000, rows

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.limit(self.rows).collect()]

    def bindings(self) -> dict:
        g, rows = self.graph, self._rows
        return {
            "graph_metadata": lambda: rows(g.metadata()),
            "graph_search": lambda q, labels=None, limit=20: rows(g.search(q, labels, limit)),
            "graph_neighbors": lambda i, t=None, limit=50: dict(zip(("nodes", "edges"), map(rows, g.neighbors(i, t, limit)), strict=True)),
            "graph_get_node": lambda i: rows(g.get_node(i))[0],
            "graph_shortest_path": lambda a, b, hops=None: rows(g.shortest_path(a, b, hops)),
            "graph_sql": lambda q, args=None: rows(g.sql(q, args)),
            "graph_aggregate": lambda q, args=None: rows(g.sql(q, args)),
            "model_query": lambda q: self.model("", [{"role": "user", "content": q}]),
        }

    def run(self, question: str) -> str:
        """The final answer; RuntimeError if the turns run out. Code runs in this process: give it a trusted model only."""
        if not question:
            raise ValueError("a question is required")
        system, space = prompt(self.graph), self.bindings()
        answer: list[str] = []
        space["FINAL"] = lambda x: answer.append(str(x))
        space["FINAL_VAR"] = lambda name: answer.append(str(space.get(name, name)))
        messages = [{"role": "user", "content": question}]
        for turn in range(self.turns):
            text = self.model(system, messages)
            log.info("turn %d: %s", turn + 1, text)
            messages.append({"role": "assistant", "content": text})
            if found := final_answer(text):
                how, value = found
                return str(space.get(value, value)) if how == "var" and is_identifier(value) else value
            blocks = code_blocks(text)
            if not blocks:
                messages.append({"role": "user", "content": "Write a ```repl block, or end with FINAL(answer)."})
                continue
            out = io.StringIO()
            for code in blocks:
                with contextlib.redirect_stdout(out):
                    try:
                        exec(code, space)  # noqa: S102  what the loop is for
                    except Exception as e:
                        print(f"[Error] {type(e).__name__}: {e}")
                if answer:
                    return answer[-1]
            messages.append({"role": "user", "content": truncated(out.getvalue() or "(no output)", self.output_chars)})
        raise RuntimeError(f"no answer after {self.turns} turns")
