"""The subpackage's entries of the query registry, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, html, mixing, neardup, oracle, pii, quality, repeats, sharding, urls

QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_pii": pii.op2,
    "op3_html": html.op3,
    "op4_mixing": mixing.op4,
    "op5_urls": urls.op5,
    "op6_decontamination": decontamination.op6,
    "op7_chat": chat.op7,
    "op8_quality": quality.op8,
    "op9_repeats": repeats.op9,
    "op10_near_duplicates": neardup.op10,
}
ORACLE_SQL = {
    "op2_pii": oracle.PII, "op4_mixing": oracle.MIXING, "op6_decontamination": oracle.DECONTAMINATION, "op7_chat": oracle.CHAT,
    "op9_repeats": oracle.REPEATS, "op10_near_duplicates": oracle.NEAR_DUPLICATES,
}
