"""Column functions; all of them are evaluated in the JVM."""
