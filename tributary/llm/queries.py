"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.bytepair import op11_byte_bpe
from tributary.llm.chat import op3_chat_formatting
from tributary.llm.fim import OP13_SQL, op13_fill_in_middle
from tributary.llm.fingerprints import op2_document_fingerprints
from tributary.llm.licenses import OP7_SQL, op7_license_scans
from tributary.llm.mixing import OP4_SQL, op4_mixing_sources
from tributary.llm.near_dedup import OP9_SQL, op9_minhash_near_dedup
from tributary.llm.negatives import OP12_SQL, op12_hard_negatives
from tributary.llm.packing import op5_packing
from tributary.llm.quality import OP10_SQL, op10_quality_rules
from tributary.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from tributary.llm.suffix_dedup import OP1_SQL, op1_suffix_array_dedup
from tributary.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op4_mixing_sources": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_license_scans": OP7_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
