"""Graphviz text of graphs: one row per line, in a stable order, for ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours of the edge kinds.
COLOURS = {"true": "forestgreen", "false": "red", "other": "black", "direct": "black", "indirect": "blue", "unknown": "red", "unwind": "orange"}


def edge_lines(edges: DataFrame, *by: str) -> DataFrame:
    """(by..., line) of (src, dst[, kind])."""
    line = F.format_string("  %s -> %s", F.col("src").cast("string"), F.col("dst").cast("string"))
    if "kind" in edges.columns:
        colour = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("kind")), F.lit("black"))
        line = F.concat(line, F.lit(" [color="), colour, F.lit("]"))
    return edges.select(*by, F.concat(line, F.lit(";")).alias("line"))


def clustered(nodes: DataFrame) -> DataFrame:
    """(cluster, line): a subgraph for each cluster of (node, cluster) with two nodes or more."""
    g = nodes.groupBy("cluster").agg(F.sort_array(F.collect_set(F.col("node").cast("string"))).alias("m")).where(F.size("m") > 1)
    return g.select("cluster", F.format_string("  subgraph cluster_%s { %s; }", F.col("cluster").cast("string"), F.array_join("m", "; ")).alias("line"))


def document(lines: DataFrame, name: str = "g") -> DataFrame:
    """Head, sorted lines and end, as one text column."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "o int, line string")
    return head.unionByName(lines.select(F.lit(1).alias("o"), "line")).orderBy("o", "line").select("line")


#: Label, colour and style of the edges of flow graphs, and of interprocedural ones.
FLOW_STYLES = {"true": ("True", "forestgreen", ""), "false": ("False", "crimson", ""), "equality": ("==", "deepskyblue", ""), "indirect": ("Indirect", "indigo", "dashed"), "unwind": ("Unwind", "tomato4", "dotted")}
ICFG_STYLES = {"call_to_entry": ("call", "deepskyblue", "dashed"), "return_to_call": ("return", "crimson", "dashed"), "call_to_return": ("skip", "forestgreen", "dotted")}


def _attributes(style: tuple[str, str, str], value=None):
    label, colour, how = style
    text = F.lit(label) if value is None else F.concat(F.lit(f"{label} "), value)
    return F.concat(F.lit(' [label="'), text, F.lit(f'",color="{colour}"' + (f',style="{how}"' if how else "") + "]"))


def styled_lines(edges: DataFrame, styles: dict[str, tuple[str, str, str]], *by: str) -> DataFrame:
    """(by..., line) of (src, dst, kind[, case_value]): edges of a kind with a style have its label,
    colour and style; an equality edge's label has the value that it stands for; others are plain."""
    tail = F.lit("")
    for kind, style in styles.items():
        value = F.coalesce(F.col("case_value").cast("string"), F.lit("?")) if kind == "equality" and "case_value" in edges.columns else None
        tail = F.when(F.col("kind") == kind, _attributes(style, value)).otherwise(tail)
    return edges.select(*by, F.concat(F.format_string("  %s -> %s", F.col("src").cast("string"), F.col("dst").cast("string")), tail, F.lit(";")).alias("line"))


def node_lines(nodes: DataFrame, *by: str) -> DataFrame:
    """(by..., line) of (node, label)."""
    return nodes.select(*by, F.format_string('  %s [label="%s"];', F.col("node").cast("string"), "label").alias("line"))


def block_clusters(nodes: DataFrame) -> DataFrame:
    """(fn, b, body): the subgraph of each block of (fn, b, ord, node, name), nodes in order."""
    g = nodes.groupBy("fn", "b").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("node").cast("string").alias("n")))).alias("m"), F.max("name").alias("name"))
    inner = F.array_join(F.transform("m", lambda x: x["n"]), "; ")
    return g.select("fn", "b", F.concat(F.format_string('subgraph cluster_%s_%s { label="%s"; ', F.col("fn").cast("string"), F.col("b").cast("string"), "name"), inner, F.lit("; }")).alias("body"))


def function_clusters(blocks: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn, line): the subgraph of each function around those of its blocks (fn, b, body); ``functions``
    is (fn, name)."""
    g = blocks.groupBy("fn").agg(F.sort_array(F.collect_list(F.struct("b", "body"))).alias("m")).join(functions, "fn")
    inner = F.array_join(F.transform("m", lambda x: x["body"]), " ")
    return g.select("fn", F.concat(F.format_string('  subgraph cluster_%s { label="%s"; ', F.col("fn").cast("string"), "name"), inner, F.lit(" }")).alias("line"))
