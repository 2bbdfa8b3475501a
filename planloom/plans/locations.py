"""Where files live: local or any Hadoop path, or a container of a lake account."""

from __future__ import annotations

from planloom.plans.model import Storage


def locations(storage: Storage) -> list[str]:
    """The paths of a file storage as Spark should see them."""
    paths = [storage.path] if isinstance(storage.path, str) else list(storage.path)
    if not storage.in_lake:
        return paths
    root = f"abfss://{storage.container}@{storage.storage_account}.dfs.core.windows.net/"
    return [root + path for path in paths]
