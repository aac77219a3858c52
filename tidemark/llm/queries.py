"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import collocations, decontaminate, licenses, line_dedup, lm_score, packing, quality, secrets, simhash, suffix_dedup, token_align, tool_chat, toxicity

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_toxicity": toxicity.query,
    "op3_decontaminate": decontaminate.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_licenses": licenses.query,
    "op6_simhash": simhash.query,
    "op7_lm_score": lm_score.query,
    "op8_quality": quality.query,
    "op9_tool_chat": tool_chat.query,
    "op10_packing": packing.query,
    "op11_collocations": collocations.query,
    "op12_line_dedup": line_dedup.query,
    "op13_token_align": token_align.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op8_quality": quality.ORACLE,
    "op9_tool_chat": tool_chat.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
