"""Spark-native analytics for lending-protocol data: reports as lazy DataFrame plans."""
