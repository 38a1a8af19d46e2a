"""Column expressions: everything here is JVM-side and side-effect free."""
