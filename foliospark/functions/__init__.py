"""Column functions: geometry of boxes, text predicates, markup."""
