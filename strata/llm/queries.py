"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.conversation_repair import op11_conversation_repair
from strata.llm.decontamination import op1_decontamination
from strata.llm.html_text import op8_html_text
from strata.llm.jaccard_join import op5_jaccard_join
from strata.llm.lm import op7_lm_scores
from strata.llm.packing import op9_packing
from strata.llm.prefix_trie import op12_prefix_trie
from strata.llm.sql import OP5_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from strata.llm.superminhash import op13_superminhash
from strata.llm.token_counts import op4_token_counts
from strata.llm.token_files import op10_token_files
from strata.llm.topk import OP2_SQL, op2_topk_search
from strata.llm.toxicity import op6_toxicity
from strata.llm.url_filter import op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_topk_search": op2_topk_search,
    "op3_url_filter": op3_url_filter,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scores": op7_lm_scores,
    "op8_html_text": op8_html_text,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_superminhash": op13_superminhash,
}

#: None of SQL's functions reach the others' models and formats; tests/llm hold those against brute force.
ORACLE: dict[str, str] = {
    "op2_topk_search": OP2_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_superminhash": OP13_SQL,
}
