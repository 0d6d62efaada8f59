"""Selvage: marker planning for cut fabric as Spark dataflow."""
