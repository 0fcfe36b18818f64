"""functions of factloom."""
