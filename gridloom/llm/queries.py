"""The registered queries of this subpackage, each over whole tables, and the SQL where it can express one."""

from __future__ import annotations

from .decontamination import op6_decontamination
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .html_text import op9_html_text
from .line_dedup import OP5_SQL, op5_line_dedup
from .media import op7_media_columns
from .packing import op4_best_fit_packing
from .quality import op3_quality_pu
from .simhash import op2_simhash_near_dedup
from .sstable import op8_token_shards
from .token_counts import op10_token_counts
from .top_k import OP12_SQL, op12_exact_top_k
from .toxicity import op1_toxicity
from .whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash_near_dedup, op3_quality_pu, op4_best_fit_packing, op5_line_dedup, op6_decontamination, op7_media_columns, op8_token_shards, op9_html_text, op10_token_counts, op11_fill_in_middle, op12_exact_top_k, op13_embedding_whitening)}

SQL = {"op5_line_dedup": OP5_SQL, "op11_fill_in_middle": OP11_SQL, "op12_exact_top_k": OP12_SQL}
