"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from larkspan.llm import bpe, exact_dedup, filter_audit, hard_negatives, ngram_join, packing, pii, repeats, rule_ledger, secrets, sharding, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality_rules": rule_ledger.op3_quality_rules,
    "quality_rule_ablations": rule_ledger.quality_rule_ablations,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_warc": warc.op9_warc,
    "op10_pii": pii.op10_pii,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_suffix_array_dedup": repeats.op13_suffix_array_dedup,
}

SQL = {
    "op3_quality_rules": rule_ledger.OP3_SQL,
    "quality_rule_ablations": rule_ledger.ABLATIONS_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
