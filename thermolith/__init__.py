"""thermolith: a PySpark-native climate-impact emulation engine."""
