"""DataFrame operators, all keyed by ``repo_id``."""
