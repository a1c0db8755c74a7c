"""Where daily tables come from and where results go."""
