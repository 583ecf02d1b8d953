"""Registered queries: every operator on the shared tables, next to its SQL counterpart."""
