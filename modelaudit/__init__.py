"""Batch jobs on Spark for auditing machine-learning datasets and the models scored on them."""
