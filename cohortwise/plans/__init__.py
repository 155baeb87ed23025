"""Named reports: the questions a user asks, each one a short plan of operators."""
