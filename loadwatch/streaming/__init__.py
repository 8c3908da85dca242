"""The monitor on Structured Streaming: publications, daily counts, baselines and incidents with state."""
