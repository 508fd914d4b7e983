"""Part of kvartal; see the README for the map of modules."""
