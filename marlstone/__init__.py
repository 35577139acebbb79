"""PySpark-native panel analytics: DataFrame-to-DataFrame operators over (ticker, date) panels."""
