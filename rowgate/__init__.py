"""Quality gate, de-duplication and per-table load for multi-sheet record sets, on Spark DataFrames."""
