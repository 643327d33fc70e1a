"""Near-match analytics on Spark: similarity tags, radius search and de-duplication as DataFrame plans."""
