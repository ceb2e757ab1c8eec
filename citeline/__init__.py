"""Evidence-grounded document analytics expressed as Spark DataFrame plans."""
