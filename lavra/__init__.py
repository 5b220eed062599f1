"""Legal-document structuring on Spark: documents in, citable rows out."""
