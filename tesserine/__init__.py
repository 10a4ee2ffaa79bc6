"""tesserine: code-retrieval and corpus analytics expressed as Spark DataFrame plans."""
