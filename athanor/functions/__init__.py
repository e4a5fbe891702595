"""Column functions: bags, masses, scores and identifiers."""
