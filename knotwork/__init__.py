"""A PySpark-native engine for mining hyperlinked text and linking documents to concepts."""
