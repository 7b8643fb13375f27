"""barloom: a Spark-native engine for bar data, trading-rule backtests and return statistics."""
