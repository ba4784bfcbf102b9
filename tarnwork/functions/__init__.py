"""Column helpers: text, three-valued labels, vectors and masked scores."""
