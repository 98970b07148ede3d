"""Part of the twinarm engine."""
