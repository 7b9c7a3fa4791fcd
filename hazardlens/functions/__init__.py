"""Column functions; all of them stay in JVM code generation."""
