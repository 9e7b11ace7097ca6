"""All registered queries: importing this module runs every registration."""

from . import analyses, audits, files, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
