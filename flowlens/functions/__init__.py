"""Column expressions: cleaning, predicates, currency codes."""
