"""sources of shoplake."""
