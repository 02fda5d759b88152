"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from attesta.llm.chat import OP1_SQL, op1_chat_formatting
from attesta.llm.decontamination import op9_benchmark_decontamination
from attesta.llm.embedding_dedup import OP8_SQL, op8_embedding_near_dedup
from attesta.llm.kneser_ney import op2_lm_scoring
from attesta.llm.language_id import op5_language_id
from attesta.llm.mixing import OP7_SQL, op7_poisson_mix
from attesta.llm.ngram_join import OP10_SQL, op10_ngram_jaccard_join
from attesta.llm.suffix_dedup import op4_suffix_dedup
from attesta.llm.token_files import op6_token_files
from attesta.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
    "op7_poisson_mix": OP7_SQL,
    "op8_embedding_near_dedup": OP8_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
}
