"""One module per operator family."""
