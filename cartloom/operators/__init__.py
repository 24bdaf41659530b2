"""DataFrame operators of the order-to-pick-sheet flow."""
