"""Registered queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from washline.llm import chat, rules, runs, topk, trie, urls, warc
from washline.llm.chat import op1_chat_format
from washline.llm.decontaminate import op2_decontamination
from washline.llm.jaccard import op6_ngram_jaccard
from washline.llm.packing import op10_packing
from washline.llm.quality import op9_quality
from washline.llm.repeats import op4_suffix_dedup
from washline.llm.rules import op13_quality_rules
from washline.llm.runs import op11_periodic_runs
from washline.llm.topk import op8_topk
from washline.llm.toxicity import op5_toxicity
from washline.llm.trie import op12_prefix_trie
from washline.llm.urls import op3_url_filter
from washline.llm.warc import op7_warc


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_decontamination": op2_decontamination,
        "op3_url_filter": op3_url_filter,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_warc": op7_warc,
        "op8_topk": op8_topk,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    """The others learn, tokenize, or search in ways SQL cannot state at this size; tests use brute force."""
    return {**chat.ORACLE, **urls.ORACLE, **warc.ORACLE, **topk.ORACLE, **runs.ORACLE, **trie.ORACLE, **rules.ORACLE}
