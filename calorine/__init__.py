"""calorine: geospatial-temporal thermal-event analytics as lazy Spark plans."""
