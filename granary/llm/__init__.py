"""Training-data operators: token files, deduplication, decontamination, scoring, mixing."""
