"""Importing this module registers every query (see ``registry``)."""

from quarry.plans import deals, search, tagging, vectors  # noqa: F401
