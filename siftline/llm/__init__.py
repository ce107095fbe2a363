"""Operators for preparing training data, one module for each; nothing outside this folder imports it."""
