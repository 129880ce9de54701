"""Part of locusframe: streaming."""
