"""Column builders: everything here is one row in, one value out, and stays inside the JVM."""
