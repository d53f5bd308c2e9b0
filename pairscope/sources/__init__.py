"""Where samples come from and where results go."""
