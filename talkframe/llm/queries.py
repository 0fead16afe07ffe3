"""The queries of the training-data operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op5_decontamination
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .html_text import op11_html_extraction
from .lang_id import op2_language_id
from .line_dedup import op6_line_dedup
from .packing import op8_packing
from .secret_scan import op7_secret_scan
from .sharding import op10_sharding
from .simhash import op3_simhash
from .topk import OP4_SQL, op4_topk
from .toxicity import op9_toxicity
from .url_filter import OP1_SQL, op1_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_html_extraction": op11_html_extraction,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op4_topk": OP4_SQL, "op12_fill_in_middle": OP12_SQL, "op13_vector_codes": OP13_SQL}
