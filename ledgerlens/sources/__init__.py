"""Sources and sinks: CSV ingest, Parquet I/O, fingerprints, Arrow output and
the sample journal derived from the driver's tables."""
