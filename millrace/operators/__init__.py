"""Pure DataFrame transforms: dedup, upsert, null handling, change detection."""
