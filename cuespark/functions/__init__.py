"""Column expressions: JVM-side, no Python UDF."""
