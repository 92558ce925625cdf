"""functions of loomline."""
