"""Sources and sinks: parquet tables, CSV ingest/egress, training logs, fixture views."""
