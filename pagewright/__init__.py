"""Document analytics on Spark: decode, structure, query and render document collections."""

__version__ = "0.1.0"
