"""Part of locusframe: operators."""
