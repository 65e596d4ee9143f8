"""Column expressions: everything here is a JVM-side expression, never a UDF."""
