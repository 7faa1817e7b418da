"""The pattern language: its syntax tree and parser."""
