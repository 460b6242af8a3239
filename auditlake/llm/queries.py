"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.ann import OP11_SQL, op11_one_bit_neighbours
from auditlake.llm.decontaminate import OP7_SQL, op7_winnowing_decontamination
from auditlake.llm.html_text import op9_min_cut_html_text
from auditlake.llm.language_id import op10_language_id
from auditlake.llm.line_dedup import OP4_SQL, op4_line_dedup
from auditlake.llm.merkle import OP13_SQL, op13_merkle_manifest
from auditlake.llm.mixing import op5_soft_membership_mixing
from auditlake.llm.near_dedup import OP2_SQL, op2_minhash_near_dedup
from auditlake.llm.quality_rules import op3_learned_quality_rules
from auditlake.llm.suffix_dedup import OP8_SQL, op8_suffix_array_dedup
from auditlake.llm.toxicity import op6_toxicity
from auditlake.llm.variants import OP12_SQL, op12_spelling_variants
from auditlake.llm.warc import OP1_SQL, op1_warc_chunked_records


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc_chunked_records, op2_minhash_near_dedup, op3_learned_quality_rules, op4_line_dedup, op5_soft_membership_mixing, op6_toxicity, op7_winnowing_decontamination, op8_suffix_array_dedup, op9_min_cut_html_text, op10_language_id, op11_one_bit_neighbours, op12_spelling_variants, op13_merkle_manifest]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_chunked_records": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_winnowing_decontamination": OP7_SQL, "op8_suffix_array_dedup": OP8_SQL, "op11_one_bit_neighbours": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
