"""lodestone: a PySpark-native retrieval, conversation and corpus analytics engine."""
