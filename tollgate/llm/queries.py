"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, pieces, pii, quality, secrets, sharding, simhash, topk, toxicity, warc


def queries():
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_simhash": simhash.op2_simhash,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_warc": warc.op4_warc,
        "op5_pii": pii.op5_pii,
        "op6_secrets": secrets.op6_secrets,
        "op7_topk": topk.op7_topk,
        "op8_pieces": pieces.op8_pieces,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_quality": quality.op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op4_warc": warc.OP4_SQL, "op6_secrets": secrets.OP6_SQL, "op7_topk": topk.OP7_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
