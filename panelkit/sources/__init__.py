"""Where panels come from and go to."""
