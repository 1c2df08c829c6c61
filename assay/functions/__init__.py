"""Scalar functions: Column expressions where Spark can express them, Arrow-batched grammars where not."""
