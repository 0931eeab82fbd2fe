"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op13_bpe
from .conversations import OP11_SQL, op11_conversation_repair
from .decontaminate import op4_decontamination
from .jaccard import op2_jaccard_join
from .language_model import op7_language_model
from .licenses import op5_license_scan
from .lines import OP8_SQL, op8_line_dedup
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op1_packing
from .pii import op10_pii
from .quality import op6_quality_rules
from .sharding import op9_sharding
from .suffixes import op3_suffix_dedup

QUERIES = {
    "op1_packing": op1_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op7_language_model": op7_language_model,
    "op8_line_dedup": op8_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe": op13_bpe,
}

ORACLES = {"op8_line_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_hard_negatives": OP12_SQL}
