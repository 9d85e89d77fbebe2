"""A PySpark-native engine for analysing model-judgement records and the text they were made about."""
