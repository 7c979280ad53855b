"""CSV, TSV and JSON outputs."""
