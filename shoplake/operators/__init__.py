"""operators of shoplake."""
