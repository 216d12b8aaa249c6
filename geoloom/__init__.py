"""geoloom: map-data analytics expressed as Spark DataFrame plans."""
