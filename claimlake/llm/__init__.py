"""Training-data operators. Optional: nothing outside this folder imports it."""
