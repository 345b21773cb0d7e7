"""DataFrame operators over parsed documents."""
