"""Scalar expressions: built-in functions composed, Arrow UDFs only where none will do."""
