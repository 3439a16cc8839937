"""Column functions: each takes Columns and returns a Column that runs inside the JVM."""
