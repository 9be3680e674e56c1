"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.decontam import op4_decontam
from tabulon.llm.language import op6_language
from tabulon.llm.lines import op10_lines
from tabulon.llm.media import op1_media
from tabulon.llm.neardup import op8_neardup
from tabulon.llm.packing import op7_packing
from tabulon.llm.periodic import OP11_SQL, op11_runs
from tabulon.llm.preferences import OP2_SQL, op2_preferences
from tabulon.llm.spotsigs import OP13_SQL, op13_spotsigs
from tabulon.llm.substrings import op5_substrings
from tabulon.llm.toxicity import op9_toxicity
from tabulon.llm.trie import OP12_SQL, op12_trie
from tabulon.llm.weak_labels import op3_quality
from tabulon.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_media": _on_documents(op1_media),
    "op2_preferences": lambda spark, sf_dir: op2_preferences(table(spark, sf_dir, "conversations")),
    "op3_quality": _on_documents(op3_quality),
    "op4_decontam": lambda spark, sf_dir: op4_decontam(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op5_substrings": _on_documents(op5_substrings),
    "op6_language": _on_documents(op6_language),
    "op7_packing": _on_documents(op7_packing),
    "op8_neardup": _on_documents(op8_neardup),
    "op9_toxicity": lambda spark, sf_dir: op9_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_lines": _on_documents(op10_lines),
    "op11_runs": _on_documents(op11_runs),
    "op12_trie": lambda spark, sf_dir: op12_trie(table(spark, sf_dir, "conversations")),
    "op13_spotsigs": _on_documents(op13_spotsigs),
}

ORACLE_SQL: dict[str, str] = {
    "op2_preferences": OP2_SQL,
    "op11_runs": OP11_SQL,
    "op12_trie": OP12_SQL,
    "op13_spotsigs": OP13_SQL,
}
