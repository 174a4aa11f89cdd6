"""Names that queries, operators and functions share (fixed values)."""

TASKS = ("query_rewriter", "chunk_summarizer", "feature_extractor")
INTENTS = ("prior_art", "ownership", "landscape", "freedom_to_operate", "citation_lookup")
