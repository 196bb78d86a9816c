"""Reading, writing and deriving the clinical tables."""
