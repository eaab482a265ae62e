"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .ann import op4_nearest
from .chat_format import OP9_SQL, op9_chat_format
from .day_layout import op12_late_layout
from .decontaminate import op3_decontaminate
from .exact_dedup import OP11_SQL, op11_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .jaccard_join import op7_jaccard_join
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_mixing
from .private import op10_private
from .quality import op2_quality
from .suffix_dedup import op8_substring_dedup
from .token_shards import op1_token_shards

QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_private": op10_private,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_late_layout": op12_late_layout,
    "op13_filter_audit": op13_filter_audit,
}
SQL = {
    "op5_mixing": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
