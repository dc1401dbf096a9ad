"""Column functions of the feed engine."""

from . import addresses, dates, names, text, urls

__all__ = ["addresses", "dates", "names", "text", "urls"]
