"""Operators for preparing training data from web text; nothing else in the package imports this subpackage."""
