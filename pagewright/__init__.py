"""Pagewright: web and search analytics as plain PySpark DataFrame functions."""
