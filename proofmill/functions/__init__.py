"""Column expressions: text rules, JSON access, probability tails."""
