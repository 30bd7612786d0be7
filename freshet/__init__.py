"""River-basin and terrain analytics as DataFrame-to-DataFrame functions on Spark."""
