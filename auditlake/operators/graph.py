"""Knowledge graph (GRA-*): nodes(id, node_type, title, content, source, tags), edges(source_id, target_id, relation, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id long, node_type string, title string, content string, source string, tags string"
EDGES = "source_id long, target_id long, relation string, weight double"


def search(nodes: DataFrame, query: str, node_type: str | None = None, limit: int = 20) -> DataFrame:
    """GRA-1: nodes with the text in title, content or tags, whatever its case; the first by id."""
    q = F.lower(F.lit(query))
    hit = F.lit(False)
    for c in ("title", "content", "tags"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    own = nodes.where(hit) if node_type is None else nodes.where(hit & (F.col("node_type") == node_type))
    return own.orderBy("id").limit(limit)


def related(nodes: DataFrame, edges: DataFrame, starts: DataFrame, relation: str | None = None) -> DataFrame:
    """GRA-2 / JOI-9: starts(start_id) -> (start_id, relation, weight, node columns) one step away."""
    own = edges if relation is None else edges.where(F.col("relation") == relation)
    step = starts.join(own, F.col("start_id") == F.col("source_id")).select("start_id", "relation", "weight", F.col("target_id").alias("id"))
    return step.join(nodes, "id")


def of_rule(nodes: DataFrame, edges: DataFrame, rule_id: str, relation: str = "references") -> DataFrame:
    """GRA-3: regulations (`references`) or templates (`satisfies`) of a rule: its node is the first whose title or tags have the id."""
    q = F.lower(F.lit(rule_id))
    mine = nodes.where((F.col("node_type") == "rule") & (F.coalesce(F.lower("title").contains(q), F.lit(False)) | F.coalesce(F.lower("tags").contains(q), F.lit(False))))
    return related(nodes, edges, mine.agg(F.min("id").alias("start_id")), relation)


def similar_cases(nodes: DataFrame, description: str, limit: int = 5) -> DataFrame:
    return search(nodes, description, "case", limit)


def graph(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """GRA-4: a graph given as rows."""
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
