"""Bring several page collections into the common corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from inkwell.sources import corpus


def transfer(sources: Mapping[str, tuple[DataFrame, Mapping[str, str | None], str]]) -> DataFrame:
    """``{name: (rows, field map, id column)}`` -> one tagged corpus; save it with ``corpus.save``."""
    return corpus.union_corpora({name: corpus.remap(df, fields, key) for name, (df, fields, key) in sources.items()})


def transfer_to(target: str, sources: Mapping[str, tuple[DataFrame, Mapping[str, str | None], str]], fmt: str = "parquet", **options) -> None:
    """The same, saved to a collection: every source is appended by a job of its own, under the committer of its format.

    An existing target is an error for the first source, so that nothing is ever added to another collection."""
    for i, (name, source) in enumerate(sources.items()):
        corpus.save(transfer({name: source}), target, fmt, "append" if i else "error", **options)
