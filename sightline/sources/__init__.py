"""Where entities come from and where recordings go."""
