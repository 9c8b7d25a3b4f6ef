"""Training-data operators: tokenising, quality, de-duplication, privacy and scoring."""
