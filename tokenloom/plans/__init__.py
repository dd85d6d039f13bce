"""Physical building blocks: hot-group handling, ordering, lineage cuts."""
