"""Tables that people edit elsewhere: fetched at most every few minutes, checked, and kept where a fetch fails."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming.watch import REFRESH_S, due
from . import sinks, tables

MOST_BYTES = 5_000_000


def refresh(spark: SparkSession, cache: str, fetch: Callable[[int], bytes], required: str, now: float, every: float = REFRESH_S, most: int = MOST_BYTES, force: bool = False) -> DataFrame:
    """Rows of a CSV, as strings, by the header's names; of the copy at ``cache`` if that is not yet due.

    ``fetch`` returns at most as many bytes as it is given; the download is the caller's. A response that is longer than
    ``most``, or whose header lacks ``required``, counts as a failure: the old rows stay, and the next try is due
    after ``every`` seconds. Rows without a copy are none.
    """
    saved: dict = {}
    if tables.exists(spark, cache):
        try:
            saved = json.loads(spark.read.format("text").option("wholetext", "true").load(cache).first()[0])
        except (TypeError, ValueError):
            saved = {}
    if force or due(saved.get("checked_at"), now, every):
        saved = {**saved, "checked_at": now, "error": None}
        try:
            raw = fetch(most + 1)
            if len(raw) > most:
                raise ValueError(f"more than {most} bytes")
            rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"))))
            if not rows or required not in rows[0]:
                raise ValueError(f"no column {required}")
            saved |= {"columns": rows[0], "rows": [(r + [None] * len(rows[0]))[: len(rows[0])] for r in rows[1:] if any(r)]}
        except Exception as e:  # whatever went wrong, the old rows hold
            saved["error"] = str(e)[:500]
        sinks.replace_text(spark, cache, json.dumps(saved, ensure_ascii=False))
    columns = saved.get("columns") or [required]
    return spark.createDataFrame(saved.get("rows", []), ", ".join(f"`{c.replace('`', '``')}` string" for c in columns))
