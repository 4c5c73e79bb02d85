"""Queries of this folder by name, each with its SQL counterpart or None."""

from __future__ import annotations

from tidemark.llm import (
    bpe,
    decontaminate,
    divergence,
    langid,
    licenses,
    linededup,
    lm,
    maintext,
    neardup,
    quality,
    topk,
    turnrepair,
    warc,
)

ALL = {
    "op1_decontaminate": (decontaminate.op1, None),
    "op2_quality": (quality.op2, None),
    "op3_norm_topk": (topk.op3, topk.OP3_SQL),
    "op4_byte_bpe": (bpe.op4, None),
    "op5_line_templates": (linededup.op5, linededup.OP5_SQL),
    "op6_warc": (warc.op6, warc.OP6_SQL),
    "op7_near_copies": (neardup.op7, None),
    "op8_attention_lm": (lm.op8, None),
    "op9_licenses": (licenses.op9, None),
    "op10_language": (langid.op10, None),
    "op11_divergence": (divergence.op11, divergence.OP11_SQL),
    "op12_turn_repair": (turnrepair.op12, turnrepair.OP12_SQL),
    "op13_main_text": (maintext.op13, None),
}
