"""Credentials for lake locations."""

from __future__ import annotations

from collections.abc import Mapping

from planloom.plans.locations import locations
from planloom.plans.model import Plan, PlanError

__all__ = ["lake_settings", "locations"]


def lake_settings(plan: Plan, sas_tokens: Mapping[tuple[str, str], str] | None = None) -> dict[str, str]:
    """Session settings that let Spark open every lake location of the plan.

    A token comes from the storage itself or from `sas_tokens`, keyed by (storage account, container). Storages without
    either get no settings, so that credentials configured on the cluster stay in force. Each container gets
    keys of its own: the `blob` key of older drivers, and the fixed token of drivers that know containers. The key that holds for a whole account is
    set only if all its containers here have one token.
    """
    tokens: dict[tuple[str, str], str] = {}
    for storage in plan.storages():
        if not storage.in_lake:
            continue
        place = storage.storage_account, storage.container
        token = storage.sas_token or (sas_tokens or {}).get(place)
        if token is None:
            continue
        if tokens.setdefault(place, token) != token:
            raise PlanError("the plan gives more than one SAS token for container {1!r} of storage account {0!r}".format(*place))
    settings: dict[str, str] = {}
    for (account, container), token in tokens.items():
        host = f"{account}.dfs.core.windows.net"
        settings[f"fs.azure.account.auth.type.{host}"] = "SAS"
        settings[f"fs.azure.sas.{container}.{account}.blob.core.windows.net"] = token
        settings[f"fs.azure.sas.fixed.token.{container}.{host}"] = token
        if {other for (name, _), other in tokens.items() if name == account} == {token}:
            settings[f"fs.azure.sas.fixed.token.{host}"] = token
    return settings
