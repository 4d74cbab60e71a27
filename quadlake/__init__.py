"""PySpark-native RDF and SPARQL analytics engine."""
