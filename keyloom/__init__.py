"""keyloom: relational structure of undeclared tables, inferred with Spark."""
