"""operators of helixframe."""
