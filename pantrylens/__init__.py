"""Inventory-demand analytics expressed as Spark DataFrame operators."""
