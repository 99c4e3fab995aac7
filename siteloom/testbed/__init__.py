"""Inputs derived from the supplied tables, and the query registry over them."""

from importlib import import_module

_MODULES = ("q_urls", "q_html", "q_analysis", "q_audit", "q_files", "q_streams")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
