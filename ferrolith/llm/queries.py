"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ferrolith.llm.ann import op7_ann
from ferrolith.llm.embedding_dedup import op10_embedding_dedup
from ferrolith.llm.language_id import op9_language_id
from ferrolith.llm.line_dedup import OP1_SQL, op1_line_dedup
from ferrolith.llm.lm_scoring import op4_lm_scoring
from ferrolith.llm.merkle import OP12_SQL, op12_merkle
from ferrolith.llm.mixing import op8_mixing
from ferrolith.llm.packing import op6_packing
from ferrolith.llm.quality import op2_quality
from ferrolith.llm.resampling import op13_resampling
from ferrolith.llm.secrets import op11_secrets
from ferrolith.llm.simhash import op5_simhash
from ferrolith.llm.token_output import op3_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_token_output": op3_token_output,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_ann": op7_ann,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_secrets": op11_secrets,
    "op12_merkle": op12_merkle,
    "op13_resampling": op13_resampling,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op12_merkle": OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
