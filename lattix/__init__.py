"""lattix: a PySpark-native engine for lattice (areal and point) statistics over DataFrames."""

__version__ = "0.1.0"
