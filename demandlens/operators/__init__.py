"""DataFrame operators: deduplication, artist resolution, roll-ups, ranking."""
