"""Session set-up, pinning and skew-safe ordering, and the whole weekly job."""
