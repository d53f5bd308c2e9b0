"""How pairs are laid out over tasks."""
