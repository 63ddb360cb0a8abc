"""A PySpark-native engine for layered tables: contracts, upsert, quality, drift and marts."""
