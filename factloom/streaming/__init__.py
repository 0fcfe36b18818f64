"""streaming of factloom."""
