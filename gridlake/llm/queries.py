"""Queries of this subpackage and the DuckDB SQL that matches them."""

from __future__ import annotations

from .bloom_lm import op10_bloom_lm
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .hard_negatives import op13_hard_negatives
from .html_text import op8_html_text
from .licenses import OP5_SQL, op5_license_scan
from .line_dedup import op7_line_dedup
from .mixing import op1_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .order_minhash import op3_order_minhash
from .packing import op4_packing
from .simhash import op12_simhash
from .toxicity import op6_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_order_minhash": op3_order_minhash,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_text": op8_html_text,
    "op9_near_dedup": op9_near_dedup,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op5_license_scan": OP5_SQL, "op9_near_dedup": OP9_SQL}
