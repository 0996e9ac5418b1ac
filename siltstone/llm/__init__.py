"""Training-data operators. Nothing outside this package (and the entry module's guard) imports it."""
