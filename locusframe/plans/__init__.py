"""Part of locusframe: plans."""
