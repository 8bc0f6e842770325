"""Named analyses built from the operators, and their registry."""
