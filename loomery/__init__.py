"""PySpark-native analytics engine for service discovery and product operations."""
