"""A PySpark-native engine for nested time series, feature transforms and models."""
