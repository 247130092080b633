"""Tools around the library: logging, and new components."""
