"""millrace: exchange semantics and analytics as Spark DataFrame, SQL and Structured Streaming computations."""
