"""Structural pattern search over dependency treebanks, as Spark DataFrames.

``Treebank`` holds a treebank; ``compile_query`` parses the pattern language; ``load``, ``from_string``,
``trees``, ``search`` and ``search_trees`` are short cuts.
"""

from .nav import Tree, Word, render, to_displacy
from .plans.parser import QueryError, compile_query
from .plans.pattern import Pattern
from .treebank import Treebank, from_string, load, search, search_trees, trees

__all__ = ["Pattern", "QueryError", "Tree", "Treebank", "Word", "compile_query", "from_string", "load", "render", "search", "search_trees", "to_displacy", "trees"]
