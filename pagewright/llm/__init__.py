"""Training-data operators: packing, language, scoring, formatting, duplicates, safety and contamination."""
