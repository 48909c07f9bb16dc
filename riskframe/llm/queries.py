"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.bpe import op9_bpe
from riskframe.llm.centroids import OP11_SQL, op11_centroids
from riskframe.llm.chat import OP4_SQL, op4_chat_collapse
from riskframe.llm.decontaminate import OP3_SQL, op3_decontamination
from riskframe.llm.fertility import op6_fertility
from riskframe.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from riskframe.llm.html_text import op7_html
from riskframe.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from riskframe.llm.language import op2_language
from riskframe.llm.licenses import op12_licenses
from riskframe.llm.pii import op10_pii
from riskframe.llm.quality import op1_quality
from riskframe.llm.token_counts import op8_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_language": op2_language,
        "op3_decontamination": op3_decontamination,
        "op4_chat_collapse": op4_chat_collapse,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_fertility": op6_fertility,
        "op7_html": op7_html,
        "op8_token_counts": op8_token_counts,
        "op9_bpe": op9_bpe,
        "op10_pii": op10_pii,
        "op11_centroids": op11_centroids,
        "op12_licenses": op12_licenses,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL,
        "op4_chat_collapse": OP4_SQL,
        "op5_jaccard_join": OP5_SQL,
        "op11_centroids": OP11_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
