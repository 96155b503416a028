"""Financial-distress analytics as plain PySpark DataFrame operators."""
