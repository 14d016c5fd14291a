"""File, table and query sources, and export sinks."""
