"""rowloom: a PySpark-native analytics engine for user-personalisation data."""
