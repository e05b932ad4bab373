"""End-to-end plans: charts, look-ups, reprocessing, retention, publishing."""
