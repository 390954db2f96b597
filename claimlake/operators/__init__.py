"""operators of claimlake."""
