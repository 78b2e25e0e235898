"""Where photo rows come from."""
