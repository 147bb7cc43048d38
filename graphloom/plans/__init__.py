"""Multi-operator query plans and their SQL."""
