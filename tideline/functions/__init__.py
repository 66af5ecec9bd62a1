"""Column functions and codecs: keys, event types, payloads, positions, names."""
