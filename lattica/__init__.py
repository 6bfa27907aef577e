"""lattica: a Spark-native analytics engine for a memory graph (experiences, entities, claims)."""
