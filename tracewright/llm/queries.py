"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from tracewright.llm.ball_kmeans import OP11_SQL, op11_ball_kmeans
from tracewright.llm.chat_rotation import OP9_SQL, op9_chat_rotation
from tracewright.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from tracewright.llm.language_id import op8_language_id
from tracewright.llm.line_dedup import OP13_SQL, op13_line_dedup
from tracewright.llm.line_frequency import OP3_SQL, op3_line_frequency
from tracewright.llm.mixing import OP7_SQL, op7_mix_sources
from tracewright.llm.packing import op6_best_fit_packing
from tracewright.llm.quality_gam import op1_quality_gam
from tracewright.llm.token_alignment import op12_token_alignment
from tracewright.llm.token_count import op4_token_count
from tracewright.llm.topk_search import OP10_SQL, op10_topk_search
from tracewright.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_toxicity": op2_toxicity,
    "op3_line_frequency": op3_line_frequency,
    "op4_token_count": op4_token_count,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_mix_sources": op7_mix_sources,
    "op8_language_id": op8_language_id,
    "op9_chat_rotation": op9_chat_rotation,
    "op10_topk_search": op10_topk_search,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_token_alignment": op12_token_alignment,
    "op13_line_dedup": op13_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_frequency": OP3_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op9_chat_rotation": OP9_SQL,
    "op10_topk_search": OP10_SQL,
    "op11_ball_kmeans": OP11_SQL,
    "op13_line_dedup": OP13_SQL,
}
