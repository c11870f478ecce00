"""Every registered query; importing the modules registers them."""

from weftframe.plans import feeds, flagship, groups, histories, rows, rules, scripting, storage, texts  # noqa: F401
from weftframe.plans.registry import ORACLES, QUERIES  # noqa: F401
