"""PySpark-native preparation of language-model training data."""
