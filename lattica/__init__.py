"""lattica: a PySpark-native engine for tables of typed experiment records."""
