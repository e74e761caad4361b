"""name -> function(spark, sf_dir) and the matching SQL."""

from __future__ import annotations

import geoledger.plans.cleaning
import geoledger.plans.estimates
import geoledger.plans.features
import geoledger.plans.further
import geoledger.plans.inference
import geoledger.plans.linkage
import geoledger.plans.matching
import geoledger.plans.nested
import geoledger.plans.polygons
import geoledger.plans.quality
import geoledger.plans.reports
import geoledger.plans.tiers  # noqa: F401  (registers its queries)
from geoledger.plans.library import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
