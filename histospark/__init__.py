"""Spark-native image analytics: images as relations of pixels, operators as DataFrame plans."""
