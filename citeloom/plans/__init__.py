"""Registered queries: operators over the views, and the SQL that states them."""

from citeloom.plans import lookups, providers, screening, texts, verification, works

__all__ = ["lookups", "providers", "screening", "texts", "verification", "works"]
