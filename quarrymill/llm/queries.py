"""Queries of the problems tagged llm. But for grouping SQL cannot express them; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import credentials, encoding, grouping, layout, packing, shared_spans
from quarrymill.plans.session import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return layout.not_hand_written(table(spark, sf, "documents")).select("doc_id")


def p4_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return layout.not_hand_written(table(spark, sf, "documents")).select("doc_id", F.concat_ws(",", "kinds").alias("kinds"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = credentials.credential_places(table(spark, sf, "pattern_locations"), "location_id", "matched_text", "file")
    return found.select(F.col("row_id").alias("location_id"), "start_pos")


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redacted(table(spark, sf, "pattern_locations"), "location_id", "matched_text", "file").withColumnRenamed("row_id", "location_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = grouping.similar_pairs(table(spark, sf, "merge_candidates"))
    return grouping.connected_groups(pairs).select(F.col("id").alias("pattern_id"), "group_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_documents(table(spark, sf, "documents"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(encoding.token_sizes(table(spark, sf, "documents")), table(spark, sf, "pack_capacities"))


def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_levels(_packed(spark, sf), table(spark, sf, "pack_capacities"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, sf, "documents")).pairs()


def p10_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different texts, each for its smallest doc_id; p10_members says which texts it stands for."""
    return shared_spans.SharedSpans(table(spark, sf, "documents")).representative_pairs()


def p10_members(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, sf, "documents")).members()


def p10_spans(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, sf, "documents")).spans()


def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return shared_spans.shared_amounts(documents, shared_spans.SharedSpans(documents).spans())


QUERIES = {f.__name__: f for f in (p4_found, p4_kinds, p5_found, p5_redacted, p7_found, p8_ids, p9_packed, p9_fill, p10_found, p10_links, p10_members, p10_spans, p10_shared)}
SQL: dict[str, str] = {
    "p7_found": """
WITH RECURSIVE g AS (SELECT DISTINCT pattern_a AS a, pattern_b AS b FROM merge_candidates WHERE pattern_a <> pattern_b AND (CASE WHEN similarity > 1 THEN similarity >= 95 ELSE similarity >= 0.95 END)),
e AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r AS (SELECT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT id AS pattern_id, min(reached) AS group_id FROM r GROUP BY 1""",
}
