"""Lodestone: web-search and web-document analytics as Spark DataFrame plans."""
