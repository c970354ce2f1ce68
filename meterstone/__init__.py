"""Usage-cost, governance and table-history analytics as plain PySpark DataFrame functions."""
