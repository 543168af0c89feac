"""A PySpark-native engine for supply-chain disruption intelligence and corpus preparation."""
