"""Column expressions: geometry, rotations, labels."""
