"""Running a plan: register inputs, chain the SQL, write the targets."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from planloom.plans import Plan, Storage, check_plan
from planloom.sinks import write_storage
from planloom.sources import AccessToken, lake_settings, read_storage

_PLAIN_ID = re.compile(r"\w+")

log = logging.getLogger(__name__)


@dataclass
class OpenPlan:
    """A plan whose views are registered in a session of their own. Nothing has been written yet."""

    plan: Plan
    session: SparkSession
    access_token: AccessToken = field(default=None, repr=False)

    def view(self, view_id: str) -> DataFrame:
        """The current definition of a view; ids are case-insensitive."""
        return self.session.table(view_id)

    def relation(self, from_sql_query: str) -> DataFrame:
        """What a target writes: a view, or the rest of a `select * from ...` statement."""
        text = from_sql_query.strip()
        if _PLAIN_ID.fullmatch(text):
            return self.view(text)
        return self.session.sql(f"select * from {text}")

    def write_targets(self, share: Iterable[str] = ()) -> None:
        """Write the targets one after another, each as its own job over its whole lineage.

        Views named in `share` are kept after their first use, so that targets fed by the
        same view compute it once; blocks lost with an executor are recomputed from the
        lineage. Sharing also makes those targets agree on current_timestamp().
        """
        for target in self.plan.targets:
            if _PLAIN_ID.fullmatch(target.from_sql_query.strip()):
                self.relation(target.from_sql_query)  # an undefined view stops the run before the first write
        shared = [self.view(view_id).persist(StorageLevel.MEMORY_AND_DISK) for view_id in share]
        try:
            for target in self.plan.targets:
                log.debug("writing %s", target.output)
                write_storage(self.relation(target.from_sql_query), target.output, self.access_token)
        finally:
            for frame in shared:
                frame.unpersist()


def open_plan(
    spark: SparkSession,
    plan: Plan,
    *,
    access_token: AccessToken = None,
    sas_tokens: Mapping[tuple[str, str], str] | None = None,
) -> OpenPlan:
    """Check the plan and register its views. Analysis errors surface here, before any write."""
    check_plan(plan)
    session = _own_session(spark)
    for key, value in lake_settings(plan, sas_tokens).items():
        session.conf.set(key, value)
    for source, frame in zip(plan.inputs, _read_all(session, plan.inputs, access_token), strict=True):
        log.debug("registering %s", source)
        frame.createOrReplaceTempView(source.id)
    for step in plan.transformations:
        log.debug("registering view %s", step.id)
        session.sql(step.sql).createOrReplaceTempView(step.id)
    return OpenPlan(plan, session, access_token)


def run_plan(
    spark: SparkSession,
    plan: Plan,
    *,
    access_token: AccessToken = None,
    sas_tokens: Mapping[tuple[str, str], str] | None = None,
    share: Iterable[str] = (),
) -> OpenPlan:
    """All inputs, then all transformations, then all targets."""
    opened = open_plan(spark, plan, access_token=access_token, sas_tokens=sas_tokens)
    opened.write_targets(share)
    return opened


def _read_all(session: SparkSession, inputs: Sequence[Storage], access_token: AccessToken) -> list[DataFrame]:
    """All inputs at once: listing files and reading footers or headers is mostly waiting."""
    outcomes: dict[int, DataFrame | Exception] = {}

    def read(position: int) -> None:
        try:
            outcomes[position] = read_storage(session, inputs[position], access_token)
        except Exception as error:
            outcomes[position] = error

    threads = [InheritableThread(read, session=session, args=(position,)) for position in range(len(inputs))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    for position in range(len(inputs)):
        if isinstance(outcomes[position], Exception):
            raise outcomes[position]
    return [outcomes[position] for position in range(len(inputs))]


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with its own views and functions and the caller's current settings.

    A new session starts from the application's settings; what the caller changed at
    run time is copied over.
    """
    session = spark.newSession()
    inherited = session.conf.getAll
    for key, value in spark.conf.getAll.items():
        if inherited.get(key) != value and (session.conf.isModifiable(key) or not key.startswith("spark.")):
            session.conf.set(key, value)
    return session
