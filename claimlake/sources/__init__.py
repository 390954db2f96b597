"""sources of claimlake."""
