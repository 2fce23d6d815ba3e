"""Reports over the store, and the registered queries on the driver's tables."""
