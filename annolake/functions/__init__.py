"""Part of annolake; see README.md for the operator map."""
