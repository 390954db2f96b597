"""plans of claimlake."""
