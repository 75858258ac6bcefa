"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import licences, lm, media, mixing, mtree, packing, quality, repeats, secrets, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        mixing.op1_cube_mixing,
        repeats.op2_column_bwt_repeats,
        quality.op3_importance_resampling,
        simhash.op4_simhash_golay,
        packing.op5_bounded_packing,
        mtree.op6_mtree_topk,
        lm.op7_eliasfano_lm,
        licences.op8_licence_digests,
        secrets.op9_secret_ownership,
        media.op10_media_columns,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_mtree_topk": mtree.OP6_SQL, "op8_licence_digests": licences.OP8_SQL}
