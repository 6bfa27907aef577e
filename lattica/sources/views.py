"""The memory-graph tables (experiences, entities, mentions, claims, ...) as projections of the star-schema tables.

Each projection is one SELECT that Spark and DuckDB both understand, so that a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]
#: What the queries take for the present.
AS_OF = "2024-01-31 00:00:00"

SELECTS = {
    "v_experiences": """
SELECT d.doc_id AS id, e.ts AS captured_at, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE e.ts - INTERVAL '1' DAY END AS occurred_at,
  CASE d.doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'transcript' WHEN 2 THEN 'derived' ELSE 'imported' END AS source_kind, d.text AS content,
  v.embedding AS embedding, e.event_type AS meta_type, d.source AS meta_topic1, d.lang AS meta_topic2, e.props AS metadata,
  CAST(e.user_id % 10 AS STRING) AS owner, CASE WHEN d.doc_id % 3 = 0 THEN 'shared' ELSE 'private' END AS visibility,
  CASE WHEN d.doc_id % 17 = 0 THEN d.doc_id + 1 END AS superseded_by, CASE WHEN d.doc_id % 23 = 0 THEN e.ts END AS deleted_at,
  CASE WHEN d.doc_id % 5 <> 0 THEN CAST((d.doc_id * 37) % 181 - 90 AS DOUBLE) END AS lat,
  CASE WHEN d.doc_id % 5 <> 0 THEN CAST((d.doc_id * 53) % 361 - 180 AS DOUBLE) END AS lng
FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id""",
    "v_entities": """
SELECT concat('c', CAST(c_custkey AS STRING)) AS id, 'person' AS kind, c_name AS canonical_name, c_mktsegment AS alias1, CAST(NULL AS STRING) AS merged_into FROM customer
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'org', s_name, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM supplier
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'concept', p_name, p_brand,
  CASE WHEN p_partkey <> MIN(p_partkey) OVER (PARTITION BY p_name, p_brand) THEN concat('p', CAST(MIN(p_partkey) OVER (PARTITION BY p_name, p_brand) AS STRING)) END FROM part""",
    "v_line": """
SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey, MIN(l_discount) AS l_discount, MIN(l_returnflag) AS l_returnflag
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_mentions": """
SELECT DISTINCT o.o_orderkey AS experience_id, concat('c', CAST(o.o_custkey AS STRING)) AS entity_id, c.c_name AS surface_form, 'people' AS field
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN documents d ON d.doc_id = o.o_orderkey
UNION ALL SELECT DISTINCT l.l_orderkey, concat('p', CAST(l.l_partkey AS STRING)), p.p_name, 'topics'
FROM v_line l JOIN part p ON p.p_partkey = l.l_partkey JOIN documents d ON d.doc_id = l.l_orderkey""",
    "v_claims": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id, concat('c', CAST(o.o_custkey AS STRING)) AS subject_id,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'knows' WHEN o.o_orderpriority = '2-HIGH' THEN 'works_at' WHEN o.o_orderpriority = '3-MEDIUM' THEN 'prefers' ELSE 'other' END AS predicate,
  CASE WHEN l.l_linenumber % 4 = 0 THEN NULL WHEN l.l_linenumber % 2 = 0 THEN concat('s', CAST(l.l_suppkey AS STRING)) ELSE concat('p', CAST(l.l_partkey AS STRING)) END AS object_entity_id,
  CASE WHEN l.l_linenumber % 4 = 0 THEN l.l_returnflag END AS object_literal, CASE WHEN l.l_returnflag = 'R' THEN 'retracted' ELSE 'asserted' END AS polarity,
  CAST(1.0 - 5 * l.l_discount AS FLOAT) AS confidence,
  CASE WHEN (l.l_orderkey * 10 + l.l_linenumber) % 13 = 0 THEN l.l_orderkey * 10 + l.l_linenumber + 1 END AS superseded_by, o.o_orderdate AS created_at
FROM v_line l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "v_claim_sources": """
SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS experience_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'paraphrased' ELSE 'inferred' END AS support_kind FROM v_line""",
    "v_recall_events": """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'claim' ELSE 'experience' END AS target_kind, user_id AS target_id, ts AS recalled_at,
  CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'error' THEN 'wrong' WHEN 'view' THEN 'stale' END AS outcome FROM events""",
}


class Memory:
    """The tables of one folder; frames are made when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        for name in BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        spark.sql(SELECTS["v_line"]).createOrReplaceTempView("v_line")
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in SELECTS:
            raise AttributeError(name)
        return self.spark.sql(SELECTS[f"v_{name}"])


def oracle(sql: str) -> str:
    """``sql`` with the projections that it names, as one DuckDB statement."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SELECTS:
            if name in text and name not in needed:
                need(SELECTS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    ctes = [f"{n} AS ({SELECTS[n]})" for n in needed]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
