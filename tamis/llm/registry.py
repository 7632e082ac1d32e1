"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamis.llm.embdedup import op10_sorted_projections
from tamis.llm.language import op5_hyperdimensional_language
from tamis.llm.licenses import OP1_SQL, op1_license_diagonals
from tamis.llm.neighbours import op3_collision_counting
from tamis.llm.packing import op6_cost_packing
from tamis.llm.pieces import op2_nbest_pieces
from tamis.llm.secrets import op7_randomness_secrets
from tamis.llm.simhash import op9_simhash_pivots
from tamis.llm.sitestyle import op8_site_style_trees
from tamis.llm.warc import OP4_SQL, op4_warc_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_diagonals,
        op2_nbest_pieces,
        op3_collision_counting,
        op4_warc_segments,
        op5_hyperdimensional_language,
        op6_cost_packing,
        op7_randomness_secrets,
        op8_site_style_trees,
        op9_simhash_pivots,
        op10_sorted_projections,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_license_diagonals": OP1_SQL, "op4_warc_segments": OP4_SQL}
