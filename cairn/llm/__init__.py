"""Training-data operators on text and records; nothing outside this folder imports it."""
