"""Operators on texts and vectors of training data; nothing outside this subpackage imports it."""
