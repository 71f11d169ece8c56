"""Writers for typed data-stream tables."""
