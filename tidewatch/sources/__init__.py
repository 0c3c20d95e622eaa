"""Reading prediction files, streams with their metadata, thresholds and earlier results."""
