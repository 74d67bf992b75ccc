"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from rastra.llm.code_compression import OP11_SQL, op11_vector_codes
from rastra.llm.fingerprints import op9_fingerprints
from rastra.llm.line_dedup import OP3_SQL, op3_line_dedup
from rastra.llm.lm import op6_hmm_lm
from rastra.llm.near_dedup import OP8_SQL, op8_minhash_near_dedup
from rastra.llm.packing import op10_best_fit_packing
from rastra.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from rastra.llm.pii import op1_pii
from rastra.llm.pieces import op5_sentencepiece
from rastra.llm.span_dedup import OP13_SQL, op13_suffix_array
from rastra.llm.token_output import op4_token_binary
from rastra.llm.topk import OP7_SQL, op7_exact_top_k
from rastra.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_binary": op4_token_binary,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_hmm_lm": op6_hmm_lm,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_array": op13_suffix_array,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_suffix_array": OP13_SQL,
}
