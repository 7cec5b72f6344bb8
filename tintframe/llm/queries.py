"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from .bpe import op9_bpe_roundtrip
from .decontaminate import OP12_SQL, op12_decontaminate
from .embedding_dedup import OP6_SQL, op6_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_extract import op1_html_extract
from .importance import OP11_SQL, op11_importance_resample
from .jaccard import OP10_SQL, op10_jaccard_join
from .langid import op8_language_id
from .packing import op2_best_fit_packing
from .prefix_trie import OP13_SQL, op13_conversation_trie
from .secrets import op3_secret_scan
from .sharding import op4_sharding
from .training_order import op5_training_order

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_training_order": op5_training_order,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_importance_resample": op11_importance_resample,
    "op12_decontaminate": op12_decontaminate,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL = {
    "op6_embedding_dedup": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_importance_resample": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
