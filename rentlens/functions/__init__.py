"""Column → Column functions (native Catalyst expressions, no Python UDFs)."""
