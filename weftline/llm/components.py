"""Connected components of a link table, all on the executors."""

from __future__ import annotations

from weftline.linked import components

__all__ = ["components"]
