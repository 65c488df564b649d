"""Switchyard: request pre-check, routing and data preparation as PySpark DataFrame operators."""
