"""Column functions: sentence splitting, tokenising, stemming, small math helpers."""
