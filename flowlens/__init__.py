"""Flow-anomaly analytics on PySpark: clean, score, explain, evaluate and watch network-flow tables."""
