"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.conversation_repair import SQL as REPAIR_SQL
from tessera.llm.conversation_repair import op13_conversation_repair
from tessera.llm.embedding_links import SQL as EMBEDDINGS_SQL
from tessera.llm.embedding_links import op11_embedding_links
from tessera.llm.entropy_mix import op4_entropy_mix
from tessera.llm.fingerprint_index import SQL as FINGERPRINTS_SQL
from tessera.llm.fingerprint_index import op1_fingerprint_index
from tessera.llm.jaccard_join import SQL as JACCARD_SQL
from tessera.llm.jaccard_join import op8_jaccard_join
from tessera.llm.line_templates import SQL as LINES_SQL
from tessera.llm.line_templates import op2_line_templates
from tessera.llm.link_trust import op10_link_trust
from tessera.llm.matroska import op7_matroska
from tessera.llm.merkle import SQL as MERKLE_SQL
from tessera.llm.merkle import op12_merkle_manifest
from tessera.llm.ppm import op3_ppm_language
from tessera.llm.suffix_dedup import SQL as SUFFIX_SQL
from tessera.llm.suffix_dedup import op9_suffix_dedup
from tessera.llm.token_cache import op5_token_cache
from tessera.llm.winnow import SQL as WINNOW_SQL
from tessera.llm.winnow import op6_winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint_index": op1_fingerprint_index,
    "op2_line_templates": op2_line_templates,
    "op3_ppm_language": op3_ppm_language,
    "op4_entropy_mix": op4_entropy_mix,
    "op5_token_cache": op5_token_cache,
    "op6_winnow": op6_winnow,
    "op7_matroska": op7_matroska,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_link_trust": op10_link_trust,
    "op11_embedding_links": op11_embedding_links,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_fingerprint_index": FINGERPRINTS_SQL,
    "op2_line_templates": LINES_SQL,
    "op6_winnow": WINNOW_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op9_suffix_dedup": SUFFIX_SQL,
    "op11_embedding_links": EMBEDDINGS_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
