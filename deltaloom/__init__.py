"""deltaloom: compare tables by cheap aggregates, move only what differs, apply it safely."""
