"""Fieldloom: record extraction, linkage and verification as Spark DataFrame plans."""
