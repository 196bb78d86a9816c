"""Clinical analytics over nine tables, expressed as Spark DataFrame operators."""
