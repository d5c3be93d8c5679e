"""Package: sources."""
