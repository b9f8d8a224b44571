"""Part of corpusmill; see README.md for the map of the package."""
