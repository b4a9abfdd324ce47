"""Sitara: detection, masking, audit and corpus preparation on PySpark DataFrames."""
