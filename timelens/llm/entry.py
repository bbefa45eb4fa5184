"""The queries of this package, for the driver's entry module."""

from importlib import import_module

from .common import ORACLES, QUERIES

MODULES = ["topk", "warc", "langid", "licenses", "bpe", "packing", "fingerprints", "quality", "neardup", "suffixes", "exactdup", "dialogue", "alignment"]

for _name in MODULES:
    import_module(f"{__package__}.{_name}")

import_module("corpus_pipeline")

__all__ = ["ORACLES", "QUERIES"]
