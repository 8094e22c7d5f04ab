"""Part of the dataflow engine."""
