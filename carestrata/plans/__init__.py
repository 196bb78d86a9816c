"""Session set-up, shared work folder, and the catalogue of named queries."""
