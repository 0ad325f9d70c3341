"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fim import OP11_SQL, op11_fill_in_middle
from .hnsw import OP6_SQL, op6_hnsw
from .minhash import OP1_SQL, op1_minhash
from .mixing import op3_mixing
from .order_minhash import op7_order_minhash
from .packing import op4_packing
from .periodic import op13_periodic_runs
from .quality_cnn import op2_quality
from .quality_rules import OP12_SQL, op12_quality_rules
from .secrets import op10_secrets
from .toxicity import op8_toxicity
from .url_filter import OP5_SQL, op5_url_filter
from .viterbi import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_quality, op3_mixing, op4_packing, op5_url_filter, op6_hnsw, op7_order_minhash, op8_toxicity, op9_token_counts, op10_secrets, op11_fill_in_middle, op12_quality_rules, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_hnsw": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op12_quality_rules": OP12_SQL}
