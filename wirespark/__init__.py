"""A PySpark-native engine for record-oriented data: sources, sinks, codecs, functions and queries."""
