"""Training-data operators: formatting, tokenising, de-duplication, filtering, mixing and search."""
