"""DataFrame operators over coded sequences."""
