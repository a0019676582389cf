"""quernel: a relational analytics engine expressed as Spark DataFrame plans."""
