"""Training-data operators: deduplication, quality, secrets, sharding, scoring, licences, chat, tokens."""
