"""The subpackage's queries by name, and their SQL where SQL can state them.

Modules are imported when a query runs: a driver that runs one query doesn't hold all libraries.
"""

from __future__ import annotations

from importlib import import_module

#: Query to (module, function).
QUERIES = {
    "op1_substring_dedup": ("substring_dedup", "query"),
    "op2_minhash_near_dedup": ("near_dedup", "query"),
    "op3_best_fit_packing": ("packing", "query"),
    "op4_quality_rules": ("quality", "query"),
    "op5_url_filter": ("url_filter", "query"),
    "op6_secret_scan": ("secrets", "query"),
    "op7_recurrent_lm": ("language_model", "query"),
    "op8_warc": ("warc", "query"),
    "op9_token_counts": ("tokens", "length_query"),
    "op10_benchmark_decontamination": ("decontaminate", "query"),
    "op11_toxicity": ("toxicity", "query"),
    "op12_fill_in_middle": ("fill_in_middle", "query"),
    "op13_conversation_trie": ("conversation_trie", "query"),
}
SQL = {"op2_minhash_near_dedup": "near_dedup", "op5_url_filter": "url_filter", "op8_warc": "warc", "op12_fill_in_middle": "fill_in_middle", "op13_conversation_trie": "conversation_trie"}


def queries():
    def of(module, function):
        return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), function)(spark, sf_dir)

    return {name: of(*where) for name, where in QUERIES.items()} | {"pipeline": lambda spark, sf_dir: import_module("corpus_pipeline").run(spark, sf_dir)}


def oracle_sql():
    return {name: import_module(f"{__package__}.{module}").ORACLE_SQL for name, module in SQL.items()}
