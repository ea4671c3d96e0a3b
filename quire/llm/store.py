"""Intermediate tables in the shared folder, as the rest of the library keeps them."""

from ..sources.shared import drop, keep, shared_dir

__all__ = ["drop", "keep", "shared_dir"]
