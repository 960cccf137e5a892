"""The event log, read as a batch table or followed as a stream."""
