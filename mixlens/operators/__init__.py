"""DataFrame operators; see each module's docstring for its IDs and plan shape."""
