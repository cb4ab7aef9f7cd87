"""The event log, in batch and as a stream."""
