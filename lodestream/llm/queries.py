"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from .ann_tree import op1_ann_kmeans_tree
from .chat import OP6_SQL, op6_chat_perspectives
from .jaccard import op7_jaccard_join
from .langid import op5_language_codes
from .maxscore import OP4_SQL, op4_maxscore_topk
from .mixing import OP3_SQL, op3_mix_sources
from .packing import op10_best_fit_packing
from .repair import op11_conversation_repair
from .secrets import op12_secret_ledger
from .suffix import op8_suffix_dedup
from .token_store import op2_token_store
from .toxicity import op9_toxicity
from .whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_ann_kmeans_tree,
        op2_token_store,
        op3_mix_sources,
        op4_maxscore_topk,
        op5_language_codes,
        op6_chat_perspectives,
        op7_jaccard_join,
        op8_suffix_dedup,
        op9_toxicity,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_secret_ledger,
        op13_embedding_whitening,
    )
}
SQL = {"op3_mix_sources": OP3_SQL, "op4_maxscore_topk": OP4_SQL, "op6_chat_perspectives": OP6_SQL}
