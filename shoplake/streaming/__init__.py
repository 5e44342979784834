"""streaming of shoplake."""
