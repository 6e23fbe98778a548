"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, decontaminate, fill_in_middle, fingerprints, langid, near_dedup, packing, secrets, toxicity, warc, whitening
from .chat_format import ORACLE as ORACLE_OF_CHAT
from .chat_format import op1_chat_format

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_packing": packing.op2_packing,
    "op3_warc": warc.op3_warc,
    "op4_language": langid.op4_language,
    "op5_near_duplicates": near_dedup.op5_near_duplicates,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_secrets": secrets.op7_secrets,
    "op8_bpe": bpe.op8_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ann": ann.op10_ann,
    "op11_whitening": whitening.op11_whitening,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE: dict[str, str] = {
    "op1_chat_format": ORACLE_OF_CHAT,
    "op3_warc": warc.ORACLE,
    "op10_ann": ann.ORACLE,
    "op12_decontaminate": decontaminate.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
