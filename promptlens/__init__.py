"""promptlens: screening, normalising and analysing prompt and document text with PySpark."""
