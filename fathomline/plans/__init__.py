"""Queries over the supplied tables; importing this package fills the registry."""

from fathomline.plans import artifacts, graphs, inventory, ordered, sources, streams, texts, workflows  # noqa: F401
from fathomline.plans.registry import ORACLES, QUERIES  # noqa: F401
