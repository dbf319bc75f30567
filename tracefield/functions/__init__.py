"""Column functions: vectors, orientations, plane geometry."""
