"""Column expressions: everything here is a plain, JVM-side Spark expression."""
