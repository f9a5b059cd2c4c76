"""The operators' registered queries and their SQL."""

from __future__ import annotations

from skein.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, line_dedup, pii, simhash_dedup, token_counts, token_files

QUERIES = {
    "op1_simhash": simhash_dedup.op1_simhash,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_pii": pii.op7_pii,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language_id": language_id.op9_language_id,
    "op10_token_files": token_files.op10_token_files,
}
ORACLES: dict[str, str] = {
    "op2_chat_format": chat_format.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
}
