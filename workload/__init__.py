"""The registered queries and their SQL oracle."""
