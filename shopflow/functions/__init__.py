"""Scalar expressions with the meaning that the shop's queries give them."""
