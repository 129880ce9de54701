"""Part of locusframe: functions."""
