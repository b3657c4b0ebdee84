"""Where documents go."""
