"""functions of shoplake."""
