"""Operators for preparing training text: one module for each, general interfaces, no state.

Nothing outside this subpackage imports it.
"""
