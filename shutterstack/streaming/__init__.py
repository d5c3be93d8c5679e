"""Package: streaming."""
