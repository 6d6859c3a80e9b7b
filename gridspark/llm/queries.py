"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import decontaminate, hard_negatives, line_dedup, lm_scoring, mixing, near_dedup, shuffle_shards, tiff, token_files, toxicity, url_filter, vector_codes, warc_bundles


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_external_shuffle": shuffle_shards.op2_external_shuffle,
        "op3_tiff": tiff.op3_tiff,
        "op4_attention_lm": lm_scoring.op4_attention_lm,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mix": mixing.op6_mix,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_token_files": token_files.op8_token_files,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_warc_bundles": warc_bundles.op11_warc_bundles,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql():
    return {
        "op5_decontaminate": decontaminate.ORACLE,
        "op6_mix": mixing.ORACLE,
        "op7_url_filter": url_filter.oracle(),
        "op11_warc_bundles": warc_bundles.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_vector_codes": vector_codes.oracle(),
    }
