"""The registered queries of the corpus operators and, where SQL can express them, their counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from graphloom.llm import archives, bpe, classifier, common, exact, mixing, quality_rules, repeats, simhash, threads, toxicity


def op1_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_bpe_encoding": op1_bpe_encoding,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quotation_linking": threads.op4_quotation_linking,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_suffix_dedup": repeats.op6_suffix_dedup,
    "op7_warc": archives.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "rule_ablations": quality_rules.rule_ablations,
}

ORACLES = {
    "op2_exact_dedup": exact.ORACLE,
    "op4_quotation_linking": threads.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op7_warc": archives.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "rule_ablations": quality_rules.ABLATION_ORACLE,
}
