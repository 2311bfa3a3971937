"""The queries op1 to op10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .chat import op3_chat
from .count_tokens import op7_token_counts
from .decontaminate import OP5_SQL, op5_decontaminate
from .jaccard import op2_jaccard_join
from .language_model import op8_context_tree
from .quality import op10_quality
from .shard import OP9_SQL, op9_shard
from .tiff import op1_media_tiff
from .warc import op6_warc

QUERIES = {
    "op1_media_tiff": op1_media_tiff,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_context_tree": op8_context_tree,
    "op9_shard": op9_shard,
    "op10_quality": op10_quality,
}

SQL = {
    "op5_decontaminate": OP5_SQL,
    "op9_shard": OP9_SQL,
    "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f""",
}
