"""Column expressions; pure, no actions."""
