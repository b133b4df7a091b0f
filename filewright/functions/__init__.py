"""Column expressions. Everything here is Column -> Column and stays in the JVM."""
