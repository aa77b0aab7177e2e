"""Versioned change history for business entities, as Spark DataFrame operators."""
