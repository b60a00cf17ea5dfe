"""Column functions: everything here is Column in, Column out, and stays inside the JVM."""
