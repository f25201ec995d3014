"""groundshift: a Spark-native engine for raster-derived land-change questions."""
