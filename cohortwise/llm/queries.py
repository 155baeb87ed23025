"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from . import conversations, decontamination, language_id, language_model, line_dedup, near_duplicates, packing, quality, repeats, resampling, sharding, topk, warc
from .oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_topk": topk.op4_topk,
    "op5_packing": packing.op5_packing,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op7_repeats": repeats.op7_repeats,
    "op8_language_id": language_id.op8_language_id,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_resampling": resampling.op11_resampling,
    "op12_language_model": language_model.op12_language_model,
    "op13_conversations": conversations.op13_conversations,
}
