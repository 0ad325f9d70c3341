"""factloom: whole-program static analysis as queries over relational facts on Spark."""
