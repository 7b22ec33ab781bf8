"""Analytics of irregular time series and texts, declared as Spark DataFrame plans."""
