"""millrace: audit-style data operations and work-graph analytics as ordinary Spark queries."""
