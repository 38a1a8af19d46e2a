"""STR-1: continuous ingest.

Each micro-batch is one epoch of `plans.ingest`, through `foreachBatch`. State is
the tables themselves: keys and reading identities never expire, so a watermark
(which would forget them and admit a late repeat) is not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugebook.plans.ingest import ingest
from gaugebook.sources.store import Store


def both_formats(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Two feeds as one: each row is a struct of its own format, beside a null of the other."""
    parts = {"current": current, "legacy": legacy}
    kinds = {name: feed.select(F.struct(*feed.columns).alias("row")).schema["row"].dataType for name, feed in parts.items()}
    return parts["current"].select(
        F.struct(*current.columns).alias("current"), F.lit(None).cast(kinds["legacy"]).alias("legacy")
    ).unionByName(parts["legacy"].select(
        F.lit(None).cast(kinds["current"]).alias("current"), F.struct(*legacy.columns).alias("legacy")))


def start_ingest(
    store: Store,
    arrivals: DataFrame,
    checkpoint: str,
    *,
    name: str = "ingest",
    legacy: bool | DataFrame = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start ingesting a stream of current arrivals, of legacy ones (`legacy=True`), or of both
    (`legacy` is the legacy stream): then a micro-batch, and so an epoch, may hold both formats.

    `name` identifies the stream in the commits; keep it across restarts. Writers of one store
    may overlap: one that loses the race for an epoch decides again on the new state.
    """
    two = isinstance(legacy, DataFrame)
    kind = "legacy" if legacy is True else "current"

    def apply(batch: DataFrame, batch_id: int) -> None:
        feeds = {kind: batch}
        if two:
            feeds = {c: batch.filter(F.col(c).isNotNull()).select(f"{c}.*") for c in ("current", "legacy")}
        ingest(store, **feeds, stream=(name, batch_id))

    source = both_formats(arrivals, legacy) if two else arrivals
    return (
        source.writeStream.queryName(name)
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
