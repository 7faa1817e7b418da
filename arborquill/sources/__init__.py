"""CoNLL-U files, streams and texts; the treebank derived from the star schema."""
