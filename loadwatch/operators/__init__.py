"""Rules, baselines, monitors, scores, incidents and profiles as DataFrame operations."""
