"""Views over the given tables in the shapes that the operators work on."""

from loomstead.plans.registry import INPUTS

INPUTS["assets"] = """
SELECT 'S' || CAST(s_suppkey AS STRING) AS id, 'Platform' AS fs_type, s_name AS name, n_name AS category,
  CASE WHEN s_suppkey % 5 < 2 THEN NULL WHEN s_suppkey % 5 = 2 THEN 'unreasonable' ELSE 'appropriate' END AS fit,
  CASE s_suppkey % 4 WHEN 0 THEN 'missionCritical' WHEN 1 THEN 'businessCritical' WHEN 2 THEN 'businessOperational' END AS criticality,
  CASE s_suppkey % 6 WHEN 0 THEN 'plan' WHEN 1 THEN 'phaseIn' WHEN 2 THEN 'active' WHEN 3 THEN 'phaseOut' WHEN 4 THEN 'endOfLife' END AS lifecycle,
  CASE WHEN s_suppkey % 6 IN (3, 4) THEN DATE '2023-10-01' + CAST(s_suppkey * 37 % 900 AS INT) END AS end_date, CAST(s_suppkey % 101 AS DOUBLE) AS completion
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'P' || CAST(p_partkey AS STRING), 'Product', p_name, p_type,
  CASE WHEN p_size % 5 < 3 THEN NULL WHEN p_size % 5 = 3 THEN 'inappropriate' ELSE 'appropriate' END,
  CASE p_size % 4 WHEN 0 THEN 'missionCritical' WHEN 1 THEN 'businessCritical' WHEN 2 THEN 'businessOperational' END,
  CASE p_size % 6 WHEN 0 THEN 'plan' WHEN 1 THEN 'phaseIn' WHEN 2 THEN 'active' WHEN 3 THEN 'phaseOut' WHEN 4 THEN 'endOfLife' END,
  CASE WHEN p_size % 6 IN (3, 4) THEN DATE '2023-10-01' + CAST(p_partkey * 37 % 900 AS INT) END, CAST(p_partkey % 101 AS DOUBLE)
FROM part"""
INPUTS["relations"] = """
SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING) AS from_id, 'serves' AS rel, 'P' || CAST(l_partkey AS STRING) AS to_id, 'P' || CAST(l_partkey AS STRING) AS to_name FROM lineitem
UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'vendor', p_brand, p_brand FROM part
UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'capability', p_type, p_type FROM part WHERE p_size % 7 <> 0
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'org', n_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
INPUTS["topics"] = """
SELECT p_partkey AS id, p_name AS name, p_brand || ' ' || p_type AS description, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_type END AS category,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(floor(p_partkey / 6) AS BIGINT) END AS parent_id FROM part"""
INPUTS["topic_edges"] = """
SELECT DISTINCT l_suppkey AS source_id, 1000000 + l_partkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'is_part_of' WHEN 'N' THEN 'depends_on' ELSE 'references' END AS rel
FROM lineitem"""
INPUTS["claims"] = """
SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS topic_id, l_suppkey AS doc_id, l_returnflag || ' ' || l_linestatus || ' ' || CAST(l_quantity AS STRING) AS claim_text,
  CASE l_returnflag WHEN 'A' THEN 'fact' WHEN 'N' THEN 'rule' ELSE 'definition' END AS claim_type,
  CASE WHEN l_linenumber % 5 = 1 THEN 'superseded' WHEN l_linenumber % 5 = 2 THEN 'conflicted' WHEN l_linenumber % 5 = 3 THEN 'flagged' ELSE 'active' END AS status,
  CASE WHEN l_linenumber % 5 = 1 THEN l_orderkey * 8 + l_linenumber + 1 END AS superseded_by, l_shipdate AS created_at
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate
  FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l"""
INPUTS["usage_log"] = """
SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'view' THEN 'chat' WHEN 'click' THEN 'documents' WHEN 'signup' THEN 'knowledge' WHEN 'purchase' THEN 'market' ELSE 'unknown' END AS category,
  event_type AS operation, 'p' || CAST(user_id % 3 AS STRING) AS provider, 'm' || CAST(user_id % 4 AS STRING) AS model, CASE WHEN user_id % 2 = 0 THEN 'chat' ELSE 'embedding' END AS kind,
  CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value * 9) AS BIGINT) AS completion_tokens, CAST(floor(value) AS BIGINT) + CAST(floor(value * 9) AS BIGINT) AS total_tokens,
  CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS estimated, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM events"""
INPUTS["alerts"] = """
SELECT event_id AS id, 'P' || CAST(user_id AS STRING) AS asset_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'signup' THEN 'low' ELSE 'odd' END AS severity,
  event_type AS category, event_type || ' ' || CAST(event_id % 7 AS STRING) AS title,
  CASE WHEN event_id % 5 = 0 THEN '2023' WHEN event_id % 5 = 1 THEN '2023-1' || CAST(event_id % 3 AS STRING) WHEN event_id % 5 = 2 THEN '2024-01-1' || CAST(event_id % 10 AS STRING) WHEN event_id % 5 = 3 THEN '2023-02-31' END AS event_date, ts AS seen_at FROM events"""
INPUTS["chats"] = """
SELECT conv_id, conv_id % 50 AS user_id, CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS pinned, max(turn) AS last_turn, min(CASE WHEN turn = 0 THEN text END) AS title FROM conversations GROUP BY conv_id"""
INPUTS["snapshot_old"] = "SELECT doc_id AS id, text AS content, source, 'repo/' || source || '/' || CAST(doc_id AS STRING) || '.md' AS path FROM documents"
INPUTS["snapshot_new"] = """
SELECT id, CASE WHEN id % 11 = 0 THEN content || ' more' ELSE content END AS content, source, path FROM snapshot_old WHERE id % 17 <> 0
UNION ALL SELECT id + 10000000, content, source, path || '.copy' FROM snapshot_old WHERE id % 23 = 0"""
