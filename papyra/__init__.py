"""papyra: turns text collections into evidence-backed knowledge graphs with Spark DataFrames."""
