"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from memlake.llm.line_dedup import OP4_SQL, op4_line_dedup
from memlake.llm.mixing import op5_mixing
from memlake.llm.packing import op6_packing
from memlake.llm.ppm import op8_ppm
from memlake.llm.quality import op13_quality
from memlake.llm.resampling import OP11_SQL, op11_resampling
from memlake.llm.sharding import op3_sharding
from memlake.llm.shingle_join import op10_shingle_join
from memlake.llm.token_counts import op1_token_counts
from memlake.llm.topk import op7_topk
from memlake.llm.toxicity import op2_toxicity
from memlake.llm.vector_dedup import op9_vector_dedup
from memlake.llm.whitening import op12_whitening

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_topk": op7_topk,
    "op8_ppm": op8_ppm,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_shingle_join": op10_shingle_join,
    "op11_resampling": op11_resampling,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op11_resampling": OP11_SQL,
}
