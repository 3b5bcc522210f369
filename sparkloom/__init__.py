"""Network, embedding and enrichment analytics as PySpark DataFrame operators."""
