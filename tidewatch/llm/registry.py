"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, ctw, itq, langid, licenses, linededup, mixing, packing, periodic, pii, secrets, simhash, variants

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_source_mixing": mixing.query,
        "op3_nearest_neighbours": ann.query,
        "op4_secret_scan": secrets.query,
        "op5_best_fit_packing": packing.query,
        "op6_license_scan": licenses.query,
        "op7_language_id": langid.query,
        "op8_embedding_near_dedup": itq.query,
        "op9_line_dedup": linededup.query,
        "op10_lm_scoring": ctw.query,
        "op11_personal_data": pii.query,
        "op12_spelling_variants": variants.query,
        "op13_periodic_runs": periodic.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": linededup.ORACLE_SQL}
