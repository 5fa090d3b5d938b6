"""The corpus operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from vecmill.llm import ann, license_scan, mixing, ngram_join, pieces, pii, quality_rules, rule_ensemble, sharding, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_ann": ann.op4_ann,
    "op5_pii": pii.op5_pii,
    "op6_rule_ensemble": rule_ensemble.op6_rule_ensemble,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_pieces": pieces.op9_pieces,
    "op10_warc": warc.op10_warc,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_license_scan": license_scan.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_warc": warc.SQL,
}
