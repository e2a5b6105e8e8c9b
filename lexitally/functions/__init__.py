"""Column functions: text cleaning, stemming, URLs, markup and key addresses."""
