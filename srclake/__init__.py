"""A Spark-native batch analysis engine for source trees and text corpora."""
