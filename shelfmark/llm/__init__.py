"""Operators for large text corpora. Nothing else in shelfmark imports this subpackage."""
