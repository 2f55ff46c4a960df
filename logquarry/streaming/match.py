"""Match arriving lines to a trained template set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators import templates as tp
from logquarry.session import cut_lineage


def match_stream(
    lines: DataFrame, templates: DataFrame, path: str, checkpoint: str, keys: list[str]
) -> StreamingQuery:
    """Matched lines go to ``path/matched``, the others to ``path/unmatched``, per batch."""
    # the template set stays the same, so it is written and measured once for all batches
    templates = cut_lineage(templates.select("template_id", "template"))
    small = tp.is_small(templates, "template")

    def write(batch: DataFrame, batch_id: int) -> None:
        # both outputs read it
        matched = cut_lineage(tp.match_templates(batch, templates, keys, small=small))
        for name, condition in (("matched", "template_id is not null"), ("unmatched", "template_id is null")):
            # a folder per batch: a batch that runs again replaces its own rows
            matched.filter(condition).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
