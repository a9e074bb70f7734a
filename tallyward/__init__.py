"""Federated-update analytics and training-data preparation on PySpark."""
