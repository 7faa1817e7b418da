"""Pattern search over nested sentences or over flat words."""
