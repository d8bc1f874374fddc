"""Where reviews come from and where results go."""
