"""Node predicates, regular expressions and statistics as column expressions."""
