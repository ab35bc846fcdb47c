"""lodemark: a Spark-first analytics engine for multi-source text evidence."""
