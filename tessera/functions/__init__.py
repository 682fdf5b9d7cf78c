"""Column functions: text and line metrics, lexical views, literals, versions, formulas."""
