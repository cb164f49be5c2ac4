"""Build plans: content-addressed layers and the dictionary build."""
