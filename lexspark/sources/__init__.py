"""Reading, landing and writing corpora; pages and payloads to records."""
