"""The whole screen, the registered queries and their SQL."""
