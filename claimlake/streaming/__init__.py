"""streaming of claimlake."""
