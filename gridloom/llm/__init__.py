"""Training-data operators. Nothing else in gridloom imports this subpackage."""
