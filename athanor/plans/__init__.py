"""Plan algebra: partial orders of steps."""
