"""Queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphtables.llm.ann import op2_nearest_neighbours
from graphtables.llm.bpe import op8_byte_bpe
from graphtables.llm.decontaminate import OP6_SQL, op6_decontaminate
from graphtables.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from graphtables.llm.language import op7_language
from graphtables.llm.line_dedup import OP10_SQL, op10_line_dedup
from graphtables.llm.quality import op5_quality
from graphtables.llm.token_counts import op3_token_counts
from graphtables.llm.token_shards import op9_token_shards
from graphtables.llm.url_filter import op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_shards": op9_token_shards,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op10_line_dedup": OP10_SQL,
}
