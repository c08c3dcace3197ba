"""Sources and sinks: driver tables, derived listings, CSV scans and writes."""
