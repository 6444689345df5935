"""Stored collections, catalogs and exports."""
