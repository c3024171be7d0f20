"""Plan-level helpers and the composed end-to-end jobs."""
