"""Checks made before anything is read or written.

SQL is left to Spark's analyzer, which reports bad statements while views are
registered and therefore also before the first write.
"""

from __future__ import annotations

import os
import re
import warnings

from planloom.plans.locations import locations
from planloom.plans.model import Plan, PlanError, Storage

# Parameters of uris that name a database.
_DATABASE_KEYS = {"database", "databasename"}

_VIEW_ID = re.compile(r"\w+|`[^`]+`")

# The save modes Spark's writer knows.
SAVE_MODES = {"append", "overwrite", "ignore", "error", "errorifexists"}


def check_plan(plan: Plan) -> None:
    """Raise PlanError for a plan that cannot or must not run; warn on redefined ids."""
    steps = [*plan.inputs, *plan.transformations]
    for step in steps:
        _check_id(step.id)
    _warn_on_redefinition([step.id for step in steps])
    for storage in plan.storages():
        _check_location(storage)
        if storage.mode is not None and storage.mode.lower() not in SAVE_MODES:
            raise PlanError(f"unknown save mode {storage.mode!r} in {storage}")
    for transformation in plan.transformations:
        if not isinstance(transformation.sql, str) or not transformation.sql.strip():
            raise PlanError(f"transformation {transformation.id!r} has no SQL")
    for target in plan.targets:
        if not isinstance(target.from_sql_query, str) or not target.from_sql_query.strip():
            raise PlanError(f"target {target.output} does not say what to write")
        _refuse_self_overwrite(plan, target.output)


def _check_id(view_id: object) -> None:
    if not isinstance(view_id, str) or not _VIEW_ID.fullmatch(view_id):
        raise PlanError(f"{view_id!r} is not a view id: one plain identifier is needed")


def _warn_on_redefinition(ids: list[str]) -> None:
    seen: set[str] = set()
    for view_id in ids:
        if view_id.lower() in seen:
            warnings.warn(f"view {view_id!r} is defined more than once; later steps see the last one", stacklevel=3)
        seen.add(view_id.lower())


def _check_location(storage: Storage) -> None:
    needed = ("path",) if storage.is_file else ("table", "uri")
    if storage.in_lake:
        needed += ("container",)
    missing = [name for name in needed if not getattr(storage, name)]
    if missing:
        raise PlanError(f"{storage} lacks {', '.join(missing)}")


def _refuse_self_overwrite(plan: Plan, output: Storage) -> None:
    """Overwriting drops what is there before the lazy read of the same place: all rows would be lost.

    Where two places may be one, the plan is refused.
    """
    if (output.mode or ("overwrite" if output.kind == "jdbc" else "append")).lower() != "overwrite":
        return
    for source in plan.inputs:
        if source.kind == output.kind == "jdbc":
            clash = _same_database(source.uri, output.uri) and _reads(source.table, output.table)
        else:
            clash = source.is_file and output.is_file and _overlap(source, output)
        if clash:
            raise PlanError(f"{output} would overwrite what input {source.id!r} reads")


def _overlap(source: Storage, output: Storage) -> bool:
    """Whether one of the output's folders holds, or lies in, one that the source reads."""
    pairs = [(_parts(a), _parts(b)) for a in locations(source) for b in locations(output)]
    return any(a[: len(b)] == b[: len(a)] for a, b in pairs)


def _parts(path: str) -> list[str]:
    """The names on the way to a path, up to the first one with a wildcard."""
    scheme, separator, rest = path.partition("://")
    if not separator:
        scheme, rest = "file", os.path.abspath(re.sub(r"^file:", "", path))
    names = [name for name in re.sub(r"/+", "/", rest).split("/") if name not in ("", ".")]
    fixed = next((n for n, name in enumerate(names) if re.search(r"[*?\[{]", name)), len(names))
    return [scheme.lower(), *names[:fixed]]


def _same_database(left: str, right: str) -> bool:
    """Whether two uris may name one database: all but their parameters agree, and no parameter names another one."""
    (one, own), (other, theirs) = _address(left), _address(right)
    return one == other and all(own[key] == theirs[key] for key in _DATABASE_KEYS & own.keys() & theirs.keys())


def _address(uri: str) -> tuple[str, dict[str, str]]:
    """A uri without its parameters, and the parameters."""
    address, *pairs = re.split(r"[;?&]", uri.strip().lower())
    return address.rstrip("/"), dict(pair.split("=", 1) for pair in pairs if "=" in pair)


def _reads(source: str, table: str) -> bool:
    """Whether `source`, a table name or a parenthesised subquery with an alias, may read `table`.

    Names are compared by their last part: a schema left out on one side may be the default one.
    """
    name = _plain_name(table).rsplit(".", 1)[-1]
    if source.lstrip().startswith("("):
        inner = source[: source.rfind(")")]
        return re.search(rf"(?<!\w){re.escape(name)}(?!\w)", _plain_name(inner)) is not None
    return _plain_name(source).rsplit(".", 1)[-1] == name


def _plain_name(text: str) -> str:
    return re.sub(r"[\"`\[\]]", "", text).strip().lower()
