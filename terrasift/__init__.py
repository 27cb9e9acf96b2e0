"""terrasift: composable PySpark operators for provenance-tracked site inventories."""
