"""strata: medallion analytics expressed as Spark DataFrame operators."""
