"""Registered queries of this folder and their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from loanspan.llm import (
    bpe,
    decontam,
    extract,
    langid,
    negatives,
    neardup,
    pii,
    quality,
    runs,
    secrets,
    sharding,
    topk,
    toxicity,
)
from loanspan.llm.common import table, tokenizer_path


def op1_quality(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"))


def op2_minhash_neardup(spark, sf_dir):
    return neardup.query(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.query(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secrets.query(table(spark, sf_dir, "documents"))


def op5_langid(spark, sf_dir):
    return langid.query(table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return bpe.query(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


def op8_pii(spark, sf_dir):
    return pii.query(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark, sf_dir):
    return decontam.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_topk(spark, sf_dir):
    return topk.query(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.query(table(spark, sf_dir, "embeddings"))


def op13_runs(spark, sf_dir):
    return runs.query(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_langid": op5_langid,
    "op6_bpe": op6_bpe,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_topk": op11_topk,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}
ORACLE = {
    "op1_quality": quality.SQL,
    "op2_minhash_neardup": neardup.SQL,
    "op3_sharding": sharding.SQL,
    "op10_decontaminate": decontam.SQL,
    "op11_topk": topk.SQL,
    "op12_hard_negatives": negatives.SQL,
}
