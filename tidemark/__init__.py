"""Spark-native market-regime and volatility risk engine."""
