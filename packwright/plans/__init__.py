"""Registered queries (one per SURVEY operator) with their DuckDB oracle SQL, grouped
by area: corpus (text, vocabulary, encoding, packing), instruct (instruction and
preference data), loading (training-side layout), scores (score tables and ranking
re-aims), storage (sources and sinks), incremental (Structured Streaming).
``registry`` collects them for ``__spark_entry__``."""
