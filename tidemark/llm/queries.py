"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tidemark.llm import langid, minhash, mixing, packing, quality_classifier, quality_rules, suffix_dedup, token_scan, topk, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op3_warc": warc.op3_warc,
    "op5_packing": packing.op5_packing,
    "op6_token_scan": token_scan.op6_token_scan,
    "op7_langid": langid.op7_langid,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op4_minhash": minhash.op4_minhash,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op10_topk": topk.op10_topk,
}
ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op4_minhash": minhash.OP4_SQL,
    "op3_warc": warc.OP3_SQL,
    "op10_topk": topk.OP10_SQL,
}
