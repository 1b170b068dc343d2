"""Column functions: normalisers, cleaners, ladders and similarities."""
