"""Query modules; importing them fills the registry."""
from importlib import import_module

MODULES = ("rows", "joins", "aggregates", "windows", "features", "frequency", "spectra", "evaluation", "models", "vectors", "documents", "sources", "explore", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tracework.plans.{name}")
