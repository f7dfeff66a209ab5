"""From query text to a logical plan: no Spark in here."""
