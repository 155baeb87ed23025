"""Health-risk cohort analytics written as PySpark DataFrame operators."""
