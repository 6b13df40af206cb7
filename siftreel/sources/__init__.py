"""Where files come from and go to."""
