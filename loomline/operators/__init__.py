"""operators of loomline."""
