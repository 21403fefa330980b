"""Reading tables, and the folders that every executor can see."""
