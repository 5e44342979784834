"""jobs of shoplake."""
