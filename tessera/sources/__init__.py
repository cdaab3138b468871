"""Sources: words, payloads and tables."""
