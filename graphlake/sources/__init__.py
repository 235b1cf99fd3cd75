"""Where graphs, triples and content come from and go to."""
