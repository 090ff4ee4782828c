"""Queries of the training-data operators: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from .chat import op2_chat
from .decontaminate import op3_decontamination
from .embed_dedup import op5_embedding_dedup
from .langid import op6_language_id
from .near_dedup import op4_near_dedup
from .packing import op9_packing
from .quality import op8_quality
from .rules import op12_rules
from .runs import op13_runs
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op10_toxicity
from .wavelet import op7_token_shards
from .whitening import op11_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat": op2_chat,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_shards": op7_token_shards,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_rules": op12_rules,
    "op13_runs": op13_runs,
}
SQL: dict[str, str] = {}
