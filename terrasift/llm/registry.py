"""The queries and SQL of this subpackage."""

from __future__ import annotations

from .bpe_count import op7_count_tokens
from .decontam import op9_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .html_consensus import op5_main_text
from .langid import op10_language_id
from .line_dedup import op4_line_dedup
from .lm_trie import op12_lm_scores
from .mixing import OP1_SQL, op1_mix_sources
from .pii_crf import op3_pii_spans
from .pq_dedup import op2_embedding_near_duplicates
from .resample import OP13_SQL, op13_importance_resampling
from .sharding import OP6_SQL, op6_rendezvous_sharding
from .simhash import op8_simhash_near_duplicates

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_embedding_near_duplicates": op2_embedding_near_duplicates,
    "op3_pii_spans": op3_pii_spans,
    "op4_line_dedup": op4_line_dedup,
    "op5_main_text": op5_main_text,
    "op6_rendezvous_sharding": op6_rendezvous_sharding,
    "op7_count_tokens": op7_count_tokens,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_lm_scores": op12_lm_scores,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op6_rendezvous_sharding": OP6_SQL, "op11_source_divergence": OP11_SQL, "op13_importance_resampling": OP13_SQL}
