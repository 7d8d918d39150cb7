"""All query modules of the reference operators, registered on import."""

from . import extended, live, relational  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
