"""Analytics over receiver networks: decoding, folding, archiving and cleaning of SBS-1 event logs on Spark."""

__version__ = "0.1.0"
