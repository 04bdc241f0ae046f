"""DataFrame -> DataFrame operators, grouped by input kind."""
