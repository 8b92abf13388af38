"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import ann, langid, media, mixing, neardup, pieces, pii, suffix_dedup, token_store, warc


def queries() -> dict:
    return {
        "op1_personal_data": pii.op1_personal_data,
        "op2_nearest": ann.op2_nearest,
        "op3_token_ids": token_store.op3_token_ids,
        "op4_near_duplicates": neardup.op4_near_duplicates,
        "op5_media_columns": media.op5_media_columns,
        "op6_warc": warc.op6_warc,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_repeated_passages": suffix_dedup.op8_repeated_passages,
        "op9_mixture": mixing.op9_mixture,
        "op10_language_id": langid.op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": ann.OP2_SQL, "op6_warc": OP6_SQL, "op9_mixture": mixing.OP9_SQL}
