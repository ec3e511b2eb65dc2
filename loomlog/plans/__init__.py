"""How operators are laid out on Spark: predicates, partition bounds, search conditions, skew."""
