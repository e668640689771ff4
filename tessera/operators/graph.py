"""Property graphs as two DataFrames: nodes(id, labels, props) and edges(src, dst, type, props)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def match_nodes(self, name: str, label: str | None = None, props: Mapping[str, object] | None = None) -> DataFrame:
        """One column `name`, a struct of id, labels and props, for each node with the label and properties."""
        n = self.nodes
        if label:
            n = n.where(F.array_contains("labels", label))
        for k, v in (props or {}).items():
            n = n.where(F.col("props")[k] == F.lit(str(v)))
        return n.select(F.struct("id", "labels", "props").alias(name))

    def _directed(self, direction: str, kind: str | None) -> DataFrame:
        e = self.edges if kind is None else self.edges.where(F.col("type") == kind)
        out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.struct("src", "dst", "type", "props").alias("_e"))
        back = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), F.struct("src", "dst", "type", "props").alias("_e"))
        return {"out": out, "in": back, "either": out.unionByName(back)}[direction]

    def hop(self, rows: DataFrame, start: str, to: str, label: str | None = None, props: Mapping[str, object] | None = None, kind: str | None = None, direction: str = "out", edge: str | None = None, optional: bool = False) -> DataFrame:
        """rows extended along edges from node column `start` to a new node column `to`; optional keeps rows without a match."""
        steps = self._directed(direction, kind)
        ends = self.match_nodes("_end", label, props)
        steps = steps.join(ends, F.col("_to") == F.col("_end.id")).select("_from", F.col("_e").alias(edge or "_edge"), F.col("_end").alias(to))
        out = rows.join(steps, rows[start]["id"] == F.col("_from"), "left" if optional else "inner").drop("_from")
        return out if edge else out.drop("_edge")

    def bfs(self, start: list, depth: int, direction: str = "either", kind: str | None = None) -> DataFrame:
        """id and depth of every node within `depth` hops of the start ids (edges to ids that are no nodes lead nowhere); the frontier is checkpointed in each round."""
        steps = self._directed(direction, kind).select("_from", "_to").distinct().join(self.nodes.select(F.col("id").alias("_to")), "_to", "left_semi")
        seen = cut_lineage(self.nodes.where(F.col("id").isin(start)).select("id", F.lit(0).alias("depth")))
        frontier = seen
        for d in range(1, depth + 1):
            found = frontier.join(steps, frontier["id"] == F.col("_from")).select(F.col("_to").alias("id")).distinct()
            frontier = cut_lineage(found.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth")))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen

    def project(self, start: list, depth: int, kinds: list[str] | None = None) -> Graph:
        """The subgraph of nodes within `depth` hops and the edges between them."""
        ids = self.bfs(start, depth).select("id")
        e = self.edges if kinds is None else self.edges.where(F.col("type").isin(kinds))
        e = e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), e.select(*self.edges.columns))

    def degrees(self) -> DataFrame:
        e = self.edges
        return e.select(F.col("src").alias("id")).unionAll(e.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def where_all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
