"""The queries of this subpackage, by registered name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_pairs import op12_byte_pairs
from .decontaminate import op5_decontaminate
from .fill_middle import ORACLE as OP13_SQL
from .fill_middle import op13_fill_middle
from .html_extract import op2_html_extract
from .jaccard_join import op10_jaccard_join
from .language_id import op9_langid_nb
from .language_model import op8_lm_backoff
from .packing import op3_pack_mbs
from .quality_crf import op4_quality_crf
from .quality_rules import op7_quality_rules
from .substring_dedup import ORACLE as OP6_SQL
from .substring_dedup import op6_substring_dedup
from .toxicity import op1_toxicity_ftrl
from .vector_codes import ORACLE as OP11_SQL
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_toxicity_ftrl": op1_toxicity_ftrl,
    "op2_html_extract": op2_html_extract,
    "op3_pack_mbs": op3_pack_mbs,
    "op4_quality_crf": op4_quality_crf,
    "op5_decontaminate": op5_decontaminate,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_backoff": op8_lm_backoff,
    "op9_langid_nb": op9_langid_nb,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {"op6_substring_dedup": OP6_SQL, "op11_vector_codes": OP11_SQL, "op13_fill_middle": OP13_SQL}
