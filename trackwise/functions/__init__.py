"""Column functions: decoders, measures and predicates."""
