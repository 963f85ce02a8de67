"""Training-data operators: deduplication, decontamination, tokenisation, classifiers."""
