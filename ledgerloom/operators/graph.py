"""Property graphs: nodes and edges out of entities, and the fold of a session's turns into one graph."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one table of entities (graph, id, class) and one of links (graph, source, property, target).

    A link to an entity that isn't there makes a node of kind missing; a link to itself is an edge of kind self.
    """
    known = entities.select("graph", F.col("id"), "class", F.lit("entity").alias("kind"))
    missing = links.select("graph", F.col("target").alias("id")).distinct().join(known.select("graph", "id"), ["graph", "id"], "left_anti")
    nodes = known.unionByName(missing.select("graph", "id", F.lit(None).cast("string").alias("class"), F.lit("missing").alias("kind")))
    ends = nodes.select("graph", F.col("id").alias("target"), F.col("kind").alias("_kind"))
    edges = links.join(ends, ["graph", "target"]).select("graph", "source", "property", "target", F.when(F.col("source") == F.col("target"), "self").when(F.col("_kind") == "missing", "dangling").otherwise("link").alias("kind"))
    return nodes, edges


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of any edge."""
    ends = edges.select("graph", F.col("source").alias("id")).unionByName(edges.select("graph", F.col("target").alias("id")))
    return nodes.join(ends, ["graph", "id"], "left_anti")


def spread(edges: DataFrame) -> DataFrame:
    """Number parallel edges between the same two nodes, whichever way they point, so that they can be drawn apart."""
    from pyspark.sql import Window as W

    pair = W.partitionBy("graph", F.least("source", "target"), F.greatest("source", "target")).orderBy("property", "source")
    return edges.withColumn("lane", F.row_number().over(pair))


def node_id(session: str, turn: int, key: str) -> str:
    """A node's id: the same for the same input, wherever and however often it runs."""
    return hashlib.blake2b(f"{session}\x00{turn}\x00{key}".encode(), digest_size=8).hexdigest()


class Fold:
    """The graph of a session so far; turns come in order. It is small and can be kept as JSON between micro-batches."""

    def __init__(self, state: str | None = None):
        held = json.loads(state) if state else {}
        self.nodes: dict[str, dict] = {k: held["nodes"][k] for k in held.get("order", held.get("nodes", {}))}
        self.edges: list[list[str]] = held.get("edges", [])
        self.conflicts: list[list[str]] = held.get("conflicts", [])
        self._known = {tuple(e) for e in self.edges}
        self._at: dict[str, int] = {}  # place of each node
        self._by_value: dict[tuple[str, str], list[str]] = {}
        self._by_key: dict[str, list[str]] = {}
        for k in self.nodes:
            self._listed(k)

    def state(self) -> str:
        return json.dumps({"nodes": self.nodes, "order": list(self.nodes), "edges": self.edges, "conflicts": self.conflicts}, sort_keys=True)

    def _listed(self, k: str, data: dict | None = None) -> None:
        """Index a node, or what was added to it, by its values."""
        node = self.nodes[k]
        if k not in self._at:
            self._at[k] = len(self._at)
            self._by_key.setdefault(node["key"], []).append(k)
        for p, values in (node["data"] if data is None else data).items():
            for v in values:
                self._by_value.setdefault((p, v), []).append(k)

    def _candidates(self, e: dict) -> list[str]:
        """Nodes that share a value with the entity, and those of its key that are only named so far, in the order they came."""
        found = {k for p, values in e["data"].items() for v in values for k in self._by_value.get((p, v), ())}
        found |= {k for k in self._by_key.get(e["key"], ()) if self.nodes[k].get("missing")}
        return sorted(found, key=self._at.__getitem__)

    @staticmethod
    def _same(a: dict, b: dict) -> str:
        """merge, defer or none: classes must not differ; then all shared properties equal and a shared name merge, a part defers."""
        if a["class"] and b["class"] and a["class"] != b["class"]:
            return "none"
        shared = set(a["data"]) & set(b["data"])
        agree = {p for p in shared if set(a["data"][p]) & set(b["data"][p])}
        if not agree:
            return "none"
        if agree == shared and (a["label"] and a["label"] == b["label"] or "name" in agree):
            return "merge"
        return "defer" if len(agree) * 2 > len(shared) else "none"

    def turn(self, session: str, turn: int, incoming: list[dict], links: list[tuple[str, str, str]]) -> None:
        """Fold entities {key, class, label, data} and links (source, property, target) in; the first value written stays."""
        named: dict[str, str] = {}
        for e in incoming:
            e = {"class": e.get("class"), "label": e.get("label"), "data": {p: sorted(map(str, v)) for p, v in e.get("data", {}).items()}, "key": e["key"]}
            found, close = None, []
            for k in self._candidates(e):
                node = self.nodes[k]
                if node.get("missing") and node["key"] == e["key"]:
                    found = k
                    break
                verdict = "none" if node.get("missing") else self._same(node, e)
                if verdict == "merge":
                    found = k
                    break
                if verdict == "defer":
                    close.append(k)
            if found is None:
                found = node_id(session, turn, e["key"])
                self.nodes[found] = {**e, "missing": False}
                self._listed(found)
            else:
                node = self.nodes[found]
                node["missing"] = False
                node["class"], node["label"] = node["class"] or e["class"], node["label"] or e["label"]
                for p, v in e["data"].items():
                    if p not in node["data"]:
                        node["data"][p] = v
                        self._listed(found, {p: v})
                    elif node["data"][p] != v:
                        if f"{p} (conflict)" not in node["data"]:
                            node["data"][f"{p} (conflict)"] = v
                            self._listed(found, {f"{p} (conflict)": v})
                        self.conflicts.append([found, p, " | ".join(v)])
            self._edges((c, "closeMatch", found) for c in close)
            named[e["key"]] = found
        for source, prop, target in links:
            for end in (source, target):
                if end not in named:
                    held = next(iter(self._by_key.get(end, ())), None)
                    named[end] = held or node_id(session, turn, end)
                    if held is None:
                        self.nodes[named[end]] = {"class": None, "label": None, "data": {}, "key": end, "missing": True}
                        self._listed(named[end])
            self._edges([(named[source], "self" if named[source] == named[target] else prop, named[target])])

    def _edges(self, edges) -> None:
        for e in edges:
            if tuple(e) not in self._known:
                self._known.add(tuple(e))
                self.edges.append(list(e))


FOLDED = "session string, nodes long, edges long, conflicts long, state string"


def fold_sessions(turns: DataFrame) -> DataFrame:
    """Fold rows (session, turn, entities JSON, links JSON) into one graph for each session.

    A fold depends on all turns before, so a session is one sorted stream; memory holds its graph alone.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, graph = None, Fold()

        def row():
            return (at, len(graph.nodes), len(graph.edges), len(graph.conflicts), graph.state())

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.session != at:
                    if at is not None:
                        out.append(row())
                    at, graph = r.session, Fold()
                graph.turn(str(r.session), int(r.turn), json.loads(r.entities), [tuple(x) for x in json.loads(r.links)])
            if out:
                yield pd.DataFrame(out, columns=["session", "nodes", "edges", "conflicts", "state"])
        if at is not None:
            yield pd.DataFrame([row()], columns=["session", "nodes", "edges", "conflicts", "state"])

    rows = turns.where("session is not null").select(F.col("session").cast("string"), "turn", "entities", "links")
    return rows.repartition(n, "session").sortWithinPartitions("session", "turn").mapInPandas(run, FOLDED)
