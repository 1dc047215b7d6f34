"""Reading year tables and roles, and writing the result tables."""
