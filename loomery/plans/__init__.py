"""Named queries over the driver tables, each with SQL that states the same result."""

from . import analytics, cards, catalog, guards, places, records, routes, shop, streams, texts, views, wording
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "cards", "catalog", "guards", "places", "records", "routes", "shop", "streams", "texts", "views", "wording"]
