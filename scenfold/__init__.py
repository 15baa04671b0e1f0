"""Scenario analytics on Spark: compare the results of many model runs as DataFrame plans."""

from scenfold.metadata import DEFAULT, ModelMetadata
from scenfold.model import SymbolCatalog
from scenfold.sources.symbols import load_scenarios

__all__ = ["DEFAULT", "ModelMetadata", "SymbolCatalog", "load_scenarios"]
