"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: In the order of the operators' numbers.
MODULES = ("html_text", "mixing", "simhash", "repeats", "exact_dedup", "merkle", "quality", "pii", "byte_bpe", "token_files", "cover_tree", "prefix_trie", "divergence")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"leafspark.llm.{module}"), name)
    return out


QUERIES = _merged("QUERIES")
SQL = _merged("SQL")
