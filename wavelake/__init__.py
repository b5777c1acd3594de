"""Spark jobs for time-lapse recordings, and operators for text training sets."""
