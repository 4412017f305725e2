"""Operations that a large training-data pipeline needs; nothing else in the library imports this."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# functions of this subpackage travel to the executors by value: nothing need be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import chunk_dedup, decontaminate, minhash, mixing, quality, secrets, sharding, suffix_dedup, topk, toxicity

    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_chunk_dedup": chunk_dedup.op3_chunk_dedup,
        "op4_topk": topk.op4_topk,
        "op5_quality": quality.op5_quality,
        "op6_shards": sharding.op6_shards,
        "op7_near_duplicates": minhash.op7_near_duplicates,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, minhash, topk

    return {"op2_decontamination": decontaminate.SQL, "op4_topk": topk.SQL, "op7_near_duplicates": minhash.SQL}
