"""citebase: a PySpark-native engine for cited product facts, hybrid retrieval, answer audits and web diagnostics."""
