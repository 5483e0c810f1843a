"""Named query plans over the source tables."""
