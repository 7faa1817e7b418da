"""Operators for preparing training text at corpus scale.

Every operator takes a DataFrame plus the names of its key and payload columns, looks at no other
column (extra columns, whatever their names, cannot clash) and returns its own, documented columns.
Nothing else in the library imports this subpackage.
"""
