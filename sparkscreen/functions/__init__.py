"""Column builders: numeric guards, piecewise scores, parsers."""
