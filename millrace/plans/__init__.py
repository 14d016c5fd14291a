"""Load modes, versioned storage and catalog operations."""
