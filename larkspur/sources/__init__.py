"""Sources and sinks: Parquet, delimited text, copies in and out."""
