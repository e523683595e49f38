"""Schemas of the engine's tables, as Spark DDL."""

RAW_PAGE = "source_name STRING, page_num INT, raw_text STRING"
CLEAN_PAGE = RAW_PAGE + ", clean_text STRING, char_count INT"
CHUNK = "chunk_id STRING, source_name STRING, page_start INT, page_end INT, chunk_text STRING, char_count INT, token_estimate INT, prev_chunk_id STRING, next_chunk_id STRING"
EMBEDDING = "chunk_id STRING, source_name STRING, page_start INT, page_end INT, chunk_text STRING, char_count INT, token_estimate INT, content_hash STRING, embedding_model STRING, embedding_dim INT, embedding ARRAY<FLOAT>, updated_at TIMESTAMP"
EXTRACTION = "concepts ARRAY<STRUCT<name: STRING, type: STRING, aliases: ARRAY<STRING>, description: STRING, confidence: STRING>>, relations ARRAY<STRUCT<source: STRING, relation: STRING, target: STRING, evidence: STRING, confidence: STRING>>"
CONCEPT = "concept_id STRING, name STRING, type STRING, aliases ARRAY<STRING>, description STRING, max_confidence DOUBLE, mention_chunk_ids ARRAY<STRING>"
RELATION = "relation_id STRING, source_concept_id STRING, relation STRING, target_concept_id STRING, confidence DOUBLE, evidence STRING, chunk_id STRING, source_name STRING, page_start INT, page_end INT"
ARM = "chunk_id: STRING, retrieval_score: DOUBLE, rank: INT, feature: ARRAY<DOUBLE>"
EVENT = f"event_id STRING, ts STRING, round INT, query STRING, policy_name STRING, epsilon DOUBLE, candidate_arms ARRAY<STRUCT<{ARM}>>, chosen_arm STRUCT<chunk_id: STRING, arm_index: INT, feature: ARRAY<DOUBLE>, propensity: DOUBLE>, reward DOUBLE"
LINUCB = "dim INT, alpha DOUBLE, l2_lambda DOUBLE, A ARRAY<ARRAY<DOUBLE>>, b ARRAY<DOUBLE>"
