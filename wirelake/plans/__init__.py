"""Registered queries, one per operator of the inventory, with their SQL counterparts."""
