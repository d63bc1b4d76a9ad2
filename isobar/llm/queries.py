"""The corpus queries that ``__spark_entry__`` registers, and their SQL where SQL can express them (it adds the pipeline)."""

from __future__ import annotations

from .bpe import op9_bpe_transducer
from .jaccard import op3_rtree_jaccard
from .lines import op6_crf_line_rules
from .mixing import OP1_SQL, op1_weighted_fair_mix
from .pii import op4_feistel_pseudonyms
from .preference import OP8_SQL, op8_preference_pairs
from .quality import op2_nbsvm_quality
from .ranked import OP12_SQL, op12_tiered_search
from .sharding import op10_rendezvous_sharding
from .spelling import op11_wavelet_spelling
from .topk import OP7_SQL, op7_maxscore_top20
from .toxicity import op5_bigru_toxicity
from .warc import OP13_SQL, op13_chunked_warc

QUERIES = {
    "op1_weighted_fair_mix": op1_weighted_fair_mix,
    "op2_nbsvm_quality": op2_nbsvm_quality,
    "op3_rtree_jaccard": op3_rtree_jaccard,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_bigru_toxicity": op5_bigru_toxicity,
    "op6_crf_line_rules": op6_crf_line_rules,
    "op7_maxscore_top20": op7_maxscore_top20,
    "op8_preference_pairs": op8_preference_pairs,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_rendezvous_sharding": op10_rendezvous_sharding,
    "op11_wavelet_spelling": op11_wavelet_spelling,
    "op12_tiered_search": op12_tiered_search,
    "op13_chunked_warc": op13_chunked_warc,
}

ORACLE_SQL = {
    "op1_weighted_fair_mix": OP1_SQL,
    "op7_maxscore_top20": OP7_SQL,
    "op8_preference_pairs": OP8_SQL,
    "op12_tiered_search": OP12_SQL,
    "op13_chunked_warc": OP13_SQL,
}
