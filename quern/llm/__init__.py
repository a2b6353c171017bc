"""Training-data operators: deduplication, scoring, decontamination, mixing and sharding of documents."""
