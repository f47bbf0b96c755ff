"""Queries of the subpackage, by the names under which they are registered, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP12_SQL, op12_orchard_clusters
from .chat_format import OP6_SQL, op6_chat_format
from .chat_repair import OP11_SQL, op11_conversation_repair
from .class_lm import op9_class_lm
from .decontaminate import OP5_SQL, op5_decontaminate
from .fingerprints import op7_fingerprints
from .language_id import op2_language_id
from .license_scan import op8_license_scan
from .packing import op1_packing
from .sharding import OP13_SQL, op13_hilbert_shards
from .simhash import op10_simhash
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .token_files import op4_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_language_id,
        op3_substring_dedup,
        op4_token_files,
        op5_decontaminate,
        op6_chat_format,
        op7_fingerprints,
        op8_license_scan,
        op9_class_lm,
        op10_simhash,
        op11_conversation_repair,
        op12_orchard_clusters,
        op13_hilbert_shards,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_orchard_clusters": OP12_SQL,
    "op13_hilbert_shards": OP13_SQL,
}
