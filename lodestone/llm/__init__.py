"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; deleting the folder leaves the
rest of the library whole.
"""
