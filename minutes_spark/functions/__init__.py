"""Column functions: no shuffles, everything stays in the JVM."""
