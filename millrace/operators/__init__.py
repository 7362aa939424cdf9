"""Relational building blocks: listings, relations, versions, constraints, lifecycles."""
