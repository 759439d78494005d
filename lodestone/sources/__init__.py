"""Readers of landed files and pages: price files, feeds, company pages."""
