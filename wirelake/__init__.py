"""Annotated drawings, circuit netlists and technical sentences as Spark tables."""
