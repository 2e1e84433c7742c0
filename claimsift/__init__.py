"""Claims classification on Spark: cleaning, exact splits, TF-IDF, linear models, reports and tagging."""
