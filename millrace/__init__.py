"""millrace: corpus curation and evaluation analytics written as Spark DataFrame plans."""
