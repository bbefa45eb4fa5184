"""End-to-end queries over the shared tables."""

from importlib import import_module

MODULES = ["timeline", "sources_q", "reports_q", "series_q", "metrics_q", "learn_q"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
