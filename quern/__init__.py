"""quern: a PySpark-native analytics engine for incident telemetry and agent trials."""
