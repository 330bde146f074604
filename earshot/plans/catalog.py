"""All named queries."""

from __future__ import annotations

from earshot.plans import catalog_explore, catalog_labels, catalog_profile, catalog_text, catalog_vectors
from earshot.plans.registry import Catalog

CATALOG = Catalog()
for _part in (catalog_text, catalog_profile, catalog_explore, catalog_vectors, catalog_labels):
    CATALOG.extend(_part.CATALOG)
