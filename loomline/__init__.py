"""loomline: analytics operators as Spark DataFrame plans."""
