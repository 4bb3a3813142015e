"""quaymark: point-in-time market-surveillance analytics as DataFrame-to-DataFrame functions on Spark."""
