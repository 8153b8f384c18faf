"""All queries that the driver can run, with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def _load() -> None:
    from . import architectures, corpus, evaluation, files, retrieval, study, systems  # noqa: F401


_load()
