"""The operators as queries on the given tables, with the SQL that must give the same result where there is one."""

from __future__ import annotations

from importlib import import_module

#: One module each; a module holds QUERIES: name -> (function of (spark, sf_dir), SQL or None).
MODULES = ["q_dedup", "q_decontamination", "q_models", "q_near", "q_packing", "q_secrets", "q_urls", "q_chat", "q_licenses", "q_warc", "q_phrases", "q_spelling"]

QUERIES = {}
for _name in MODULES:
    QUERIES.update(import_module(f"meteorium.llm.{_name}").QUERIES)
