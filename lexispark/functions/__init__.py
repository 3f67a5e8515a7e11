"""Column functions: text, stemming, weights and sparse vectors."""
