"""Readers, sinks and the civic view of the driver's tables."""
