"""Ordered key sets, record stores, bit sequences and byte encodings as Spark jobs."""
