"""Document formats: bytes in, primitives out. The decoders are plain Python; decode.py runs them on Spark."""
