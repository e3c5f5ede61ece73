"""Training-data operators: decontamination, scoring, de-duplication, packing, scans, search, formatting and counting."""
