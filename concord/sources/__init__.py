"""A — sources, sinks and catalog: registering and ingesting tables,
exporting, capturing results, describing/previewing, checksums and the
append-only audit tables."""
