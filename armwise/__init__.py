"""Spark-native analytics for paired experiment arms: scoring, resampling, ontologies and text extraction as DataFrame plans."""
