"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .compact_windows import op4_substring_dedup
from .language_crf import op7_language_id
from .learned_partitions import op2_nearest
from .ngram_join import OP8_SQL, op8_ngram_join
from .packing import op10_packing
from .suffix_tree_lm import op6_suffix_tree_lm
from .tiling import op3_decontamination
from .toxicity import op5_toxicity
from .url_rules import OP1_SQL, op1_url_filter
from .warc_derivatives import OP9_SQL, op9_warc_derivatives

QUERIES = {"op1_url_filter": op1_url_filter, "op2_nearest": op2_nearest, "op3_decontamination": op3_decontamination, "op4_substring_dedup": op4_substring_dedup, "op5_toxicity": op5_toxicity, "op6_suffix_tree_lm": op6_suffix_tree_lm, "op7_language_id": op7_language_id, "op8_ngram_join": op8_ngram_join, "op9_warc_derivatives": op9_warc_derivatives, "op10_packing": op10_packing}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op8_ngram_join": OP8_SQL, "op9_warc_derivatives": OP9_SQL}
