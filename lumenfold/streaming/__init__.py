"""Photos as a stream."""
