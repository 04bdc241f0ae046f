"""Query registry: each registered query pairs a Spark plan over the given
tables with an independent DuckDB SQL oracle computing the same rows."""
