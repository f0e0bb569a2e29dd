"""operators of tessera."""
