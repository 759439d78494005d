"""Evidence-backed analytics and corpus operators as lazy PySpark DataFrame transformations."""
