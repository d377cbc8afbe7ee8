"""Training-data pipeline operators over documents; nothing else in the library imports this."""
