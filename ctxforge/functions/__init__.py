"""Part of ctxforge."""
