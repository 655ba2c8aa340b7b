"""countflow: live estimation and data processing for partially reported counts, on Spark."""
