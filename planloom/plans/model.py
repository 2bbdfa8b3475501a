"""The plan: what to read, which SQL to run, what to write.

A plan is a small driver-side document. Nothing here touches Spark or data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from planloom.plans.secrets import MASK, mask_options, mask_text


class PlanError(ValueError):
    """The plan document is malformed, or running it would be unsafe."""


# The storage type names a plan document may use, with short aliases.
KINDS = {
    "CsvStorage": "csv",
    "ParquetStorage": "parquet",
    "JdbcStorage": "jdbc",
    "csv": "csv",
    "parquet": "parquet",
    "jdbc": "jdbc",
}


@dataclass(frozen=True, repr=False)
class Storage:
    """One place data is read from or written to; the same shape serves both directions.

    File kinds use `path` (one string or a list) and optionally the lake fields;
    `jdbc` uses `table` and `uri`. `mode` and `schema` are optional additions: a save
    mode other than the default of the kind, and a DDL schema that spares CSV inputs
    the extra pass of type inference.
    """

    kind: str
    id: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)
    path: str | tuple[str, ...] | None = None
    storage_account: str | None = None
    container: str | None = None
    sas_token: str | None = None
    table: str | None = None
    uri: str | None = None
    mode: str | None = None
    schema: str | None = None

    @classmethod
    def from_dict(cls, data: Mapping) -> Storage:
        """Unknown keys are ignored, absent ones are None, absent options are empty."""
        name = data.get("json_type")
        if name not in KINDS:
            raise PlanError(f"unsupported storage type: {name!r} (known: {', '.join(KINDS)})")
        path = data.get("path")
        return cls(
            kind=KINDS[name],
            options=dict(data.get("options") or {}),
            path=tuple(path) if isinstance(path, list) else path,
            **{
                key: data.get(key)
                for key in ("id", "storage_account", "container", "sas_token", "table", "uri", "mode", "schema")
            },
        )

    @property
    def is_file(self) -> bool:
        return self.kind in ("csv", "parquet")

    @property
    def in_lake(self) -> bool:
        return self.is_file and self.storage_account is not None

    def __repr__(self) -> str:
        shown = {
            "id": self.id,
            "path": self.path,
            "storage_account": self.storage_account,
            "container": self.container,
            "sas_token": self.sas_token and MASK,
            "table": self.table,
            "uri": mask_text(self.uri),
            "mode": self.mode,
            "schema": self.schema,
            "options": mask_options(self.options) or None,
        }
        fields = ", ".join(f"{key}={value!r}" for key, value in shown.items() if value is not None)
        return f"Storage({self.kind}, {fields})"


@dataclass(frozen=True)
class Transformation:
    """One SQL statement whose result becomes the view `id`."""

    id: str
    sql: str

    @classmethod
    def from_dict(cls, data: Mapping) -> Transformation:
        """Exactly `id` and `sql`; anything else is an error."""
        missing, extra = {"id", "sql"} - set(data), set(data) - {"id", "sql"}
        if missing or extra:
            problems = [f"missing {', '.join(sorted(missing))}"] if missing else []
            problems += [f"unexpected {', '.join(sorted(extra))}"] if extra else []
            raise PlanError(f"transformation {data.get('id')!r}: {'; '.join(problems)}")
        return cls(**data)


@dataclass(frozen=True)
class Target:
    """A relation to write: a view id, or any text that may follow `select * from`."""

    from_sql_query: str
    output: Storage

    @classmethod
    def from_dict(cls, data: Mapping) -> Target:
        return cls(data.get("from_sql_query"), Storage.from_dict(data.get("output") or {}))


@dataclass(frozen=True)
class Plan:
    """Inputs, transformations and targets, each in the order they are carried out."""

    inputs: Sequence[Storage] = ()
    transformations: Sequence[Transformation] = ()
    targets: Sequence[Target] = ()

    @classmethod
    def from_dict(cls, data: Mapping) -> Plan:
        return cls(
            inputs=tuple(map(Storage.from_dict, data.get("inputs") or ())),
            transformations=tuple(map(Transformation.from_dict, data.get("transformations") or ())),
            targets=tuple(map(Target.from_dict, data.get("targets") or ())),
        )

    def storages(self) -> list[Storage]:
        """Every place the plan touches, inputs first."""
        return [*self.inputs, *(target.output for target in self.targets)]
