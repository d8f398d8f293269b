"""Network-flow window analytics on Apache Spark."""
