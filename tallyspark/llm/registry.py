"""The queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from tallyspark.llm import decontamination, jaccard, line_dedup, mixing, negatives, packing, quality, quotation, secrets, tokens, toxicity, trie, urls

QUERIES = {"op1_token_files": tokens.op1_token_files, "op2_url_filter": urls.op2_url_filter, "op3_secrets": secrets.op3_secrets, "op4_quality": quality.op4_quality, "op5_quotation_linking": quotation.op5_quotation_linking, "op6_line_dedup": line_dedup.op6_line_dedup, "op7_jaccard_join": jaccard.op7_jaccard_join, "op8_decontamination": decontamination.op8_decontamination, "op9_toxicity": toxicity.op9_toxicity, "op10_packing": packing.op10_packing, "op11_mixing": mixing.op11_mixing, "op12_hard_negatives": negatives.op12_hard_negatives, "op13_prefix_trie": trie.op13_prefix_trie}
ORACLES: dict[str, str] = {"op5_quotation_linking": quotation.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_jaccard_join": jaccard.ORACLE, "op8_decontamination": decontamination.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_prefix_trie": trie.ORACLE}
