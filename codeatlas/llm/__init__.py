"""Operators of a training-data pipeline (toxicity, mixing, token files, near
duplicates, exact search, packing, token counts, page extraction, language
identification, quality rules). Nothing else in the library imports this."""
