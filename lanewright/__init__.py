"""Spark-native operators for register-write event logs and integer time series."""
