"""Package: plans."""
