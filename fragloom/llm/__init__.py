"""Training-data operators. Nothing else in fragloom imports this subpackage."""
