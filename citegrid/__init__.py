"""Bibliographic and document record analytics on PySpark."""
