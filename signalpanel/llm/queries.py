"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from .align import op13_align
from .decontam import op9_decontaminate
from .htmltext import op8_html_text
from .linededup import OP5_SQL, op5_line_dedup
from .mixing import OP3_SQL, op3_mix
from .pii import op10_pii
from .phrases import OP12_SQL, op12_phrases
from .ppm import op11_ppm
from .quality import OP4_SQL, op4_quality
from .simhash import op1_simhash
from .substring import op7_substring_dedup
from .tokenbin import op6_token_ids
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_mix": op3_mix,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_ids": op6_token_ids,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_ppm": op11_ppm,
    "op12_phrases": op12_phrases,
    "op13_align": op13_align,
}
ORACLE = {
    "op2_warc": OP2_SQL,
    "op3_mix": OP3_SQL,
    "op4_quality": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op12_phrases": OP12_SQL,
}
