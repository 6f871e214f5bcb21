"""flowmill: DataFrame operators for packet-flow, evidence and record analytics on Spark."""
