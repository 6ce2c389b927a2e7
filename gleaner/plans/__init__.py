"""Plans over the given tables."""

from importlib import import_module

MODULES = ["score", "resolve", "gates", "verdict", "text", "extract", "lifecycle", "monitor", "serve", "inbox", "streams", "run"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"gleaner.plans.{name}")
