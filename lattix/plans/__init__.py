"""Running arrays, explaining plans, and the queries over the tables."""
