"""Spark-native analytics over large fleets of numerical-model ensemble runs."""
