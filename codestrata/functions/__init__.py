"""Column builders: scalar rules that compose inside any DataFrame plan."""
