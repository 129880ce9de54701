"""Part of locusframe: sources."""
