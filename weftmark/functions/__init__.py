"""Part of weftmark."""
