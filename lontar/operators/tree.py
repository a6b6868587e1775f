"""Trees of nodes: cascades of labels to descendants, nesting and printing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def closure(nodes: DataFrame, levels: int = 8) -> DataFrame:
    """(doc_id, node_idx, depth, path) of nodes (doc_id, node_idx, parent_idx): the indexes from the root to the node.

    Each round joins the nodes whose parent the last one found, by document and parent; trees have few levels."""
    known = nodes.where("parent_idx is null").select("doc_id", "node_idx", F.lit(0).alias("depth"), F.array("node_idx").alias("path"))
    out, children = known, nodes.where("parent_idx is not null").select("doc_id", "node_idx", "parent_idx")
    for depth in range(1, levels):
        up = known.select("doc_id", F.col("node_idx").alias("parent_idx"), "path")
        known = children.join(up, ["doc_id", "parent_idx"]).select("doc_id", "node_idx", F.lit(depth).alias("depth"), F.concat("path", F.array("node_idx")).alias("path"))
        out = out.union(known)
    return out


def with_path(nodes: DataFrame) -> DataFrame:
    """nodes with their path, worked out only where they do not have it."""
    return nodes if "path" in nodes.columns else nodes.join(closure(nodes).select("doc_id", "node_idx", "path"), ["doc_id", "node_idx"])


def cascade(nodes: DataFrame, column: str, kind: str) -> DataFrame:
    """nodes with `column` taken from the nearest ancestor-or-self of the given type, as after an edit of its label."""
    at = with_path(nodes).select("doc_id", "node_idx", F.explode("path").alias("up"))
    own = nodes.where(F.col("node_type") == kind).select("doc_id", F.col("node_idx").alias("up"), F.col("label").alias("_label"))
    near = at.join(own, ["doc_id", "up"]).groupBy("doc_id", "node_idx").agg(F.max_by("_label", "up").alias("_label"))
    return nodes.join(near, ["doc_id", "node_idx"], "left").withColumn(column, F.coalesce("_label", F.when(F.col("parent_idx").isNull() & (F.col("node_type") != kind), F.col(column)))).drop("_label")


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, outline): one line a node, indented by depth."""
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.col("node_type"), F.when(F.col("label").isNotNull(), F.concat(F.lit(" "), F.col("label"))).otherwise(""))
    lined = with_path(nodes).select("doc_id", F.struct("node_idx", line.alias("line")).alias("x"))
    return lined.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("outline"))


def nested(nodes: DataFrame, levels: int = 4) -> DataFrame:
    """(doc_id, tree): nodes nested as JSON, children in order, from the deepest level up."""
    depth = with_path(nodes).withColumn("depth", F.size("path") - 1)
    kids = None
    for level in range(levels, -1, -1):
        here = depth.where(F.col("depth") == level)
        if kids is not None:
            here = here.join(kids, ["doc_id", "node_idx"], "left")
        children = F.coalesce(F.col("children"), F.lit("[]")) if kids is not None else F.lit("[]")
        body = F.to_json(F.struct("node_type", "label", "content"))
        text = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"children":'), children, F.lit("}"))
        each = here.select("doc_id", F.col("parent_idx").alias("up"), F.struct("node_idx", text.alias("t")).alias("x"))
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), ","), F.lit("]"))
        if level:
            kids = each.groupBy("doc_id", F.col("up").alias("node_idx")).agg(listed.alias("children"))
        else:
            return each.groupBy("doc_id").agg(listed.alias("tree"))


def sparse_order(nodes: DataFrame) -> DataFrame:
    """nodes with order_index: thousands among the nodes of one parent and type; articles and dictums count together."""
    kind = F.when(F.col("node_type") == "diktum", "pasal").otherwise(F.col("node_type"))
    within = Window.partitionBy("doc_id", F.coalesce("parent_idx", F.lit(-1)), "section", kind).orderBy("node_idx")
    return nodes.withColumn("order_index", (F.row_number().over(within) * 1000).cast("long"))
