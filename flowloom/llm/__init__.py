"""Training-data operators: each module holds one operator and its registered query.

``QUERIES`` maps query names to ``(spark, sf_dir) -> DataFrame`` and ``ORACLES`` maps those that
SQL can express to DuckDB SQL.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "quality",
    "decontaminate",
    "secrets",
    "shards",
    "licenses",
    "warc",
    "substrings",
    "bpe",
    "exact",
    "simhash",
    "records",
    "merkle",
    "whitening",
)

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
