"""Tidemark: commerce event and chat analytics as Spark DataFrame operators, in batch and as streams."""
