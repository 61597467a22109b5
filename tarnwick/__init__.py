"""A Spark-native engine for gene- and insertion-level screening tables."""
