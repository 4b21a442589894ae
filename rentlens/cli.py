"""Command line: build once, or watch the inputs and build when they change."""

from __future__ import annotations

import argparse
import datetime
import functools
import threading
import uuid
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import build
from .sources import sinks, tables, versions
from .streaming import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rentlens", description="Screen short-term rentals; results are unverified candidates.")
    p.add_argument("root", help="folder of the snapshots, in any store that Spark reads")
    p.add_argument("--output", default=None, help="where tables go; default: ROOT/out")
    p.add_argument("--as-of", default=datetime.date.today().isoformat(), help="day that expiry is judged by")
    p.add_argument("--watch", action="store_true", help="build again whenever an input changes; stop with a file ROOT/STOP")
    p.add_argument("--skip-initial-build", action="store_true", help="with --watch: if a report is there already")
    p.add_argument("--archive", action="store_true", help="also write what is out of scope to OUTPUT/archive, 250 rows a file")
    p.add_argument("--versions", action="store_true", help="publish immutable versions under OUTPUT, the current one named by OUTPUT/CURRENT")
    p.add_argument("--serve", type=int, metavar="PORT", help="with --watch: show a local OUTPUT at this port")
    p.add_argument("--interval", type=float, default=30.0, help="seconds between looks")
    return p


def _signature(spark: SparkSession, root: str):
    globs = [g for g in (f"{root}/*.csv", f"{root}/*.geojson", f"{root}/geography/*", f"{root}/listing_results/*/*") if tables.exists(spark, g)]
    if not globs:
        return None
    files = spark.read.format("binaryFile").load(globs)  # none is opened
    return watch.signature(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))).first()


def serve(output: str, port: int) -> ThreadingHTTPServer:
    """A local folder at 127.0.0.1, from another thread; stop with shutdown()."""
    folder = output.removeprefix("file://")
    server = ThreadingHTTPServer(("127.0.0.1", port), functools.partial(SimpleHTTPRequestHandler, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if a.interval < watch.LEAST_INTERVAL_S:
        parser().error(f"--interval has to be {watch.LEAST_INTERVAL_S} or more")
    spark = spark or SparkSession.builder.appName("rentlens").getOrCreate()
    output = a.output or f"{a.root}/out"
    if a.serve:
        serve(output, a.serve)
    have = versions.current(spark, output) if a.versions else tables.exists(spark, f"{output}/report/_SUCCESS")
    seen = _signature(spark, a.root) if a.watch and a.skip_initial_build and have else None

    def tell(state: str) -> None:
        row = (state, datetime.datetime.now(datetime.UTC).isoformat(), a.interval)
        sinks.replace_text(spark, f"{output}/scanner_status.json", spark.createDataFrame([row], "state string, checked_at string, interval_seconds double").toJSON().first())

    def look(*_) -> None:
        """Build if an input has changed since the last time; what fails is tried again at the next look."""
        nonlocal seen
        state = "waiting"
        if (now := _signature(spark, a.root)) != seen:
            try:
                made = build.build(spark, a.root, a.as_of, cache=f"{output}/.cache")
                build.publish(made, output, a.versions)
                if a.archive:
                    sinks.write_archive(made["out_of_scope"], f"{output}/archive")
                seen, state = now, "built"
                sinks.clear(spark)  # nothing of this build is read again
            except Exception as e:
                if not a.watch:
                    raise
                state = f"failed, to be tried again: {e}"[:500]
        tell(state)

    look()
    if not a.watch:
        return
    query = watch.watch(watch.ticks(spark), look, f"{sinks.shared_dir(spark)}/watch-{uuid.uuid4().hex}", a.interval)
    while query.isActive and not tables.exists(spark, f"{a.root}/STOP"):
        query.awaitTermination(min(a.interval, 5))
    query.stop()
    tell("stopped")


if __name__ == "__main__":
    main()
