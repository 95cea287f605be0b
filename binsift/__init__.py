"""A Spark-native engine for program-analysis tables: rule matching, ranking, taint, evidence and reporting."""
