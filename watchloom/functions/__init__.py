"""Column functions: predicates, mappings and transforms, each with a registry that users may extend."""

from .mapping import MAPPINGS
from .predicates import PREDICATES
from .transform import TRANSFORMS

__all__ = ["MAPPINGS", "PREDICATES", "TRANSFORMS"]
