"""Queries over the test tables, each with the SQL that must give the same rows."""

from checks import assets, exports, findings, inventory, ranges, sources, whole

MODULES = (sources, ranges, findings, assets, exports, whole, inventory)
