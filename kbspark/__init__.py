"""PySpark-native knowledge-base and corpus analytics."""
