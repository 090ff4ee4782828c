"""Training-data operators: dedup, packing, formatting, scoring and decontamination on Spark."""
