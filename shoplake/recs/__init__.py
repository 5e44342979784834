"""recs of shoplake."""
