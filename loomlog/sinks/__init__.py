"""Writers: the stored table, its upkeep, exports and metrics."""
