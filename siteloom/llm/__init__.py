"""Operators for training-data pipelines. Nothing outside this folder imports it."""

from importlib import import_module

_MODULES = ("q_minhash", "q_bpe", "q_shard", "q_url", "q_warc", "q_tiling", "q_license", "q_quality", "q_forest", "q_repeats", "q_whitening", "q_simhash", "q_merkle")


def load_queries() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
