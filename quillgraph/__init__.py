"""quillgraph: a PySpark-native engine for encoding and analysing large RDF-style graphs."""

from quillgraph.config import EncodeConfig, Popularity

__all__ = ["EncodeConfig", "Popularity"]
__version__ = "0.1.0"
