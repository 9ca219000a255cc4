"""loomgrid: relational analytics over scored regions, and corpus preparation, on Spark."""
