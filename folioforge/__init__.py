"""folioforge: document analytics as Spark DataFrame plans."""
