"""quern: a PySpark-native engine for map geometry, elevation grids and training-data pipelines."""
